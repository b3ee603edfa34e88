"""Licence scan with a positional rare-token index over licence texts.

Every template's words are posted with their positions; a word's weight is its inverse document frequency
over the templates. For a file, its licence words of the highest weight are looked up, each posting votes
for the place where its template would start, and templates whose votes agree on a place are compared
word by word there. A template is reported if enough of its words stand and all its key phrases do.

Places with at least half the votes of the best one are compared, and those within the slack of them, so what is reported is exact for copies
whose looked-up words stand together; a copy so broken that other places outvote it is not found.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, dealt, table

#: A-Z lower-cased, other ASCII without letters and digits blank; bytes above 127 are word characters.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))

BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
    "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an "
    "action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution"
)
BSD_THIRD = (
    "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission"
)
BSD_DISCLAIMER = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any "
    "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use "
    "data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
    "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)

#: Texts of public licences, or the notices that stand in files, with the phrases that must stand.
TEMPLATES = {
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + WARRANTY,
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    "isc-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to "
        "this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or "
        "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious "
        "action arising out of or in connection with the use or performance of this software",
        ("with or without fee is hereby granted", "provided that the above copyright notice"),
    ),
    "0bsd-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and "
        "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the "
        "author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in "
        "an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ("with or without fee is hereby granted the software is provided as is",),
    ),
    "bsd-2-clause": (BSD_CONDITIONS + " " + BSD_DISCLAIMER, ("redistribution and use in source and binary forms", "conditions are met")),
    "bsd-3-clause": (BSD_CONDITIONS + " " + BSD_THIRD + " " + BSD_DISCLAIMER, ("redistribution and use in source and binary forms", "may be used to endorse or promote products")),
    "zlib-text": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use "
        "of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute "
        "it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original "
        "software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source "
        "versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any "
        "source distribution",
        ("must not be misrepresented", "altered source versions"),
    ),
    "boost-text": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
        "license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit "
        "third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement "
        "including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all "
        "derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source "
        "language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be "
        "liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
        ("person or organization obtaining a copy", "machine executable object code"),
    ),
    "postgresql-text": (
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby "
        "granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
        ("without a written agreement is hereby granted",),
    ),
    "wtfpl-text": (
        "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is "
        "changed do what the fuck you want to public license terms and conditions for copying distribution and modification 0 you just do what the fuck you want to",
        ("you want to public license",),
    ),
    "unlicense-text": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
        "this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that "
        "recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this "
        "dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any "
        "kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event "
        "shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
        "connection with the software or the use or other dealings in the software",
        ("unencumbered software released into the public domain",),
    ),
    "apache-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        ("licensed under the apache license",),
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be "
        "useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public "
        "license for more details you should have received a copy of the gnu general public license along with this program if not see",
        ("terms of the gnu general public license", "free software foundation"),
    ),
    "lgpl-notice": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
        "the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be "
        "useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general "
        "public license for more details you should have received a copy of the gnu lesser general public license along with this library if not write to the free "
        "software foundation inc",
        ("gnu lesser general public license",),
    ),
    "agpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be "
        "useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general "
        "public license for more details you should have received a copy of the gnu affero general public license along with this program if not see",
        ("gnu affero general public license",),
    ),
    "mpl-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at http mozilla org mpl 2 0",
        ("mozilla public license",),
    ),
    "epl-notice": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at "
        "https www eclipse org legal epl 2 0",
        ("terms of the eclipse public license",),
    ),
    "cc-by": ("licensed under cc by 4 0", ("cc by 4 0",)),
    "cc-by-sa": ("licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-nd": ("licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    "cc0": ("licensed under cc0 1 0 universal", ("cc0 1 0",)),
}


class Index:
    """Postings of the templates' words; built once in each worker from a constant."""

    def __init__(self, templates: dict, rare_words: int = 16, min_share: float = 0.6, slack: int = 2):
        self.rare_words, self.min_share, self.slack = rare_words, min_share, slack
        self.words = {k: [w.encode() for w in text.split()] for k, (text, _) in templates.items()}
        self.keys = {k: [[w.encode() for w in p.split()] for p in phrases] for k, (_, phrases) in templates.items()}
        self.postings: dict[bytes, list] = defaultdict(list)
        for k, ws in self.words.items():
            for i, w in enumerate(ws):
                self.postings[w].append((k, i))
        n = len(self.words)
        self.idf = {w: math.log(1 + n / len({k for k, _ in p})) for w, p in self.postings.items()}
        #: the rarest word of a key phrase of each template: without it the template can't stand
        self.needed = {k: max((w for w in phrases[0]), key=lambda w: (self.idf.get(w, 9.0), w)) for k, phrases in self.keys.items()}
        self.needs = set(self.needed.values())

    def match(self, words: list[bytes], kinds: set[bytes]) -> dict[str, float]:
        """Share of each template's words that stand at its best place, for the templates that are found."""
        possible = {k for k, w in self.needed.items() if w in kinds}
        if not possible:
            return {}
        known = sorted((w for w in kinds if w in self.postings), key=lambda w: (-self.idf[w], w))
        votes: dict[str, Counter] = defaultdict(Counter)
        # the highest-weight words first; each possible template gets rare_words of its own words
        used: Counter = Counter()
        chosen = []
        for w in known:
            mine = {k for k, _ in self.postings[w]} & possible
            if any(used[k] < self.rare_words for k in mine):
                chosen.append(w)
                used.update(mine)
        places: dict[bytes, list[int]] = {w: [] for w in chosen}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        for w in chosen:
            for k, at in self.postings[w]:
                if k in possible:
                    for i in places[w]:
                        votes[k][i - at] += 1
        out = {}
        for k, by in votes.items():
            top = max(by.values())
            best = 0.0
            near = range(-self.slack, self.slack + 1)
            for start in sorted({s + d for s, n in by.items() if 2 * n >= top for d in near}):
                share = self._share(k, words, start)
                if share > best and self._phrases(k, words, start):
                    best = share
            if best >= self.min_share:
                out[k] = best
        return out

    def _share(self, k: str, words: list[bytes], start: int) -> float:
        ws = self.words[k]
        hit = 0
        for i, w in enumerate(ws):
            lo = max(0, start + i - self.slack)
            hit += w in words[lo : max(lo, start + i + self.slack + 1)]
        return hit / len(ws)

    def _phrases(self, k: str, words: list[bytes], start: int) -> bool:
        lo = max(0, start - self.slack)
        window = words[lo : max(lo, start + len(self.words[k]) + 2 * self.slack)]
        return all(next(stands(p, window), None) is not None for p in self.keys[k])


def stands(phrase: list[bytes], words: list[bytes]):
    """Places where the phrase's words stand one after the other."""
    at, n = -1, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return
        if words[at : at + n] == phrase:
            yield at


def scan_text(data: bytes, index: Index) -> tuple:
    """``n_words, n_base, first, last, base labels, labels, score`` of one text."""
    words = data.translate(FOLD).split()
    kinds = set(words)
    places, base = [], set()
    if b"license" in kinds:
        for label, phrase in BASE.items():
            found = list(stands([w.encode() for w in phrase.split()], words))
            places += found
            if found:
                base.add(label)
    more = index.match(words, kinds) if kinds & index.needs else {}
    labels = sorted(base | more.keys())
    score = 1.0 if base else max(more.values(), default=0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score


def scan(docs: DataFrame, templates: dict | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``, a row for each row of docs.

    Null and empty texts have no words, no places, empty labels and score 0. score is 1 where a base phrase
    stands, else the largest share of a template's words found in place. Repeated rows and ids give a row
    each, other columns are not read, an empty table gives none.

    Options: ``rare_words`` (16), how many of each possible template's own words of the highest weight are
    looked up; ``min_share`` (0.6), the share of its words that must stand in place, within ``slack`` (2)
    words, for a template to be reported.
    """
    chosen = templates or TEMPLATES
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches):
        import pyarrow as pa

        index = Index(chosen, **options)
        for b in batches:
            rows = [scan_text(t or b"", index) for t in binary_column(b, "text")]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op8(spark, sf_dir):
    return scan(dealt(table(spark, sf_dir, "documents")))


def base(spark, sf_dir):
    """The columns of op8 that the index adds nothing to, which SQL can express."""
    return op8(spark, sf_dir).drop("labels", "score")


_PLACES = " UNION ALL ".join(
    f"SELECT r, '{label}' AS label, i FROM p WHERE " + " AND ".join(f"w[i + {j}] = '{word}'" for j, word in enumerate(phrase.split())) for label, phrase in BASE.items()
)

QUERIES = {"op8_license_scan": op8, "licence_base": base}
SQL = {
    "licence_base": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license')),
x AS ({_PLACES}),
y AS (SELECT r, count(*) AS n, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN y USING (r)
"""
}
