"""Documents that a remote service turns into XML: the connector behind the scan of PDF files."""

from __future__ import annotations

import urllib.request
import uuid
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import Settings
from .tei import upload_check


class ParseService(Protocol):
    """What a Python worker calls for each file."""

    def parse(self, name: str, content: bytes) -> str: ...


class HttpParseService:
    """Posts a file as a multipart form and returns the XML of the answer."""

    def __init__(self, url: str, field: str = "input", options: dict[str, str] | None = None, timeout: float = 300.0):
        self.url, self.field, self.options, self.timeout = url, field, options or {}, timeout

    def form(self, name: str, content: bytes) -> tuple[str, bytes]:
        """The content type and the body of the request."""
        edge = uuid.uuid4().hex
        parts = [f'--{edge}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in self.options.items()]
        parts.append(f'--{edge}\r\nContent-Disposition: form-data; name="{self.field}"; filename="{name}"\r\nContent-Type: application/pdf\r\n\r\n'.encode() + content + b"\r\n")
        return f"multipart/form-data; boundary={edge}", b"".join(parts) + f"--{edge}--\r\n".encode()

    def parse(self, name: str, content: bytes) -> str:
        kind, body = self.form(name, content)
        request = urllib.request.Request(self.url, data=body, headers={"Content-Type": kind})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return answer.read().decode("utf-8")


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(paper_id, path, length, content) of the files below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("paper_id"), "path", "length", "content")


def parse_files(files: DataFrame, service: ParseService, max_bytes: int = Settings.max_upload_bytes, max_calls: int | None = None) -> DataFrame:
    """files to (paper_id, xml, error). A file that is refused or fails is an error row; max_calls bounds the calls at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content, refused in zip(batch["path"], batch["content"], batch["refused"]):
                if refused is not None:
                    rows.append((None, refused))
                    continue
                try:
                    rows.append((service.parse(name.rsplit("/", 1)[-1], bytes(content)), None))
                except Exception as e:  # the service is foreign: its failure is data here
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"paper_id": batch["paper_id"].to_numpy(), "xml": [r[0] for r in rows], "error": [r[1] for r in rows]})

    checked = files.withColumn("refused", upload_check(F.col("path"), F.col("length"), max_bytes)["message"]).select("paper_id", "path", "content", "refused")
    asked = checked.repartition(max_calls) if max_calls else checked
    return asked.mapInPandas(run, "paper_id string, xml string, error string")
