"""The extractors as table functions for SQL.

``register`` makes ``extract_facts(kind, content)`` callable with LATERAL:
``SELECT f.artifact_id, x.* FROM files f, LATERAL extract_facts(f.kind, f.content) x``. ``content`` is binary or text; a row
that a corpus would skip gives no facts. ``extract_facts(kind, content, identities => true)`` adds each fact's identity digest.

LATERAL hands over one row at a time, so each takes its digests alone. ``extract_files(TABLE(SELECT artifact_id, kind, content
FROM files))`` reads whole Arrow batches, whose digests are taken together: for executables and pages in numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, arrow_udtf, udtf
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, NullType, StringType, StructType

from factweave.functions import formats
from factweave.functions.blake3 import blake3
from factweave.sources.content import facts_of, routed_kind
from factweave.sources.rows import FACTS


class ExtractFacts:
    @staticmethod
    def analyze(kind: AnalyzeArgument, content: AnalyzeArgument, identities: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(kind.dataType, StringType):
            raise ValueError("the kind is a string")
        if not isinstance(content.dataType, StringType | BinaryType | NullType):
            raise ValueError("the content is binary or a string")
        schema = StructType().add("ord", IntegerType()).add("kind", StringType()).add("canonical", StringType()).add("line", IntegerType())
        if identities is not None:
            if not isinstance(identities.dataType, BooleanType) or identities.value is None:
                raise ValueError("identities is a constant boolean")
            if identities.value:
                schema = schema.add("identity", BinaryType())
        return AnalyzeResult(schema)

    def eval(self, kind: str | None, content: bytes | str | None, identities: bool = False) -> Iterator[tuple]:
        body = content.encode() if isinstance(content, str) else bytes(content or b"")
        read_as = routed_kind(kind or "text", body)
        for n, (k, c, line) in enumerate(formats.extract(read_as, body) if read_as else ()):
            yield (n, k, c, line, blake3(f"{k}\0{c}".encode())) if identities else (n, k, c, line)


class ExtractFiles:
    def eval(self, files: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield from facts_of(self.kept(files))

    @staticmethod
    def kept(files: pa.RecordBatch) -> Iterator[tuple[int, str, bytes]]:
        for artifact_id, kind, content in zip(files.column("artifact_id").to_pylist(), files.column("kind").to_pylist(), files.column("content")):
            body = content.as_py() or b""
            body = body.encode() if isinstance(body, str) else body
            if read_as := routed_kind(kind or "text", body):
                yield artifact_id, read_as, body


def register(spark: SparkSession) -> None:
    spark.udtf.register("extract_facts", udtf(ExtractFacts))
    spark.udtf.register("extract_files", arrow_udtf(ExtractFiles, returnType=FACTS))
