"""A few file operations in any store that Spark can reach."""

from __future__ import annotations


class Store:
    def __init__(self, spark, root: str):
        self.jvm, self.root = spark._jvm, root
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name)))

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Write a new file whole; False if there is one of that name. It shows up only when complete.

        The file is written under a name of its own and then renamed, which fails if the name is taken. A
        writer that dies in between leaves a part file that nobody waits for. The store's rename must be
        exclusive, as those of HDFS and of file systems are; a local one is done by a hard link.
        """
        if self.exists(name):
            return False
        import uuid

        part = self.at(f"{name}.{uuid.uuid4().hex}.part")
        stream = self.fs.create(part, False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                import os

                try:
                    os.link(part.toUri().getPath(), self.at(name).toUri().getPath())
                except FileExistsError:
                    return False
                return True
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.fs.getConf())
            none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.org.apache.hadoop.fs.Options.Rename.NONE.getClass(), 0)
            try:
                context.rename(part, self.at(name), none)
            except Exception as error:
                if self.exists(name):
                    return False
                raise error
            return True
        finally:
            self.fs.delete(part, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def sizes(self, name: str) -> int:
        return self.fs.getContentSummary(self.at(name)).getLength() if self.exists(name) else 0
