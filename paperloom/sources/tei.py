"""Structured document XML: scan, metadata, divisions, references. Namespaces are ignored."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..schemas import Settings

FORMATS = (".pdf",)

PARSED = (
    "error string, title string, authors array<string>, affiliations array<string>, abstract string, keywords array<string>, publication_date string, "
    "doi string, pmid string, pmc string, body string, page_count int, divs array<struct<div_pos:int,head:string,body:string>>, "
    "refs array<struct<ref_pos:int,title:string,authors:array<string>,year:string,doi:string>>"
)


def read_documents(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """(paper_id, path, xml) of the files below path; paper_id is the file's name without its extension."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(name.alias("paper_id"), "path", F.decode("content", "UTF-8").alias("xml"))


def supports_format(extension: Column) -> Column:
    return F.lower(extension).isin(*FORMATS)


def upload_check(name: Column, size: Column, most: int = Settings.max_upload_bytes) -> Column:
    """A struct of ok and message: the extension first, then the size."""
    ext = supports_format(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    message = F.when(~ext, F.lit("unsupported format")).when(size > most, F.lit("file too large"))
    return F.struct(message.isNull().alias("ok"), message.alias("message"))


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _all(e: ET.Element | None, *path: str) -> list[ET.Element]:
    """Descendants along a path of local names, each step at any depth."""
    found = [e] if e is not None else []
    for name in path:
        found = [x for f in found for x in f.iter() if x is not f and _tag(x) == name]
    return list(dict.fromkeys(found))


def _text(e: ET.Element | None) -> str:
    return "".join(e.itertext()).strip() if e is not None else ""


def _name(author: ET.Element) -> str | None:
    person = next(iter(_all(author, "persName")), None)
    parts = [_text(next(iter(_all(person, part)), None)) for part in ("forename", "surname")]
    return " ".join(p for p in parts if p) or None


def _first(e: ET.Element | None, *path: str) -> ET.Element | None:
    return next(iter(_all(e, *path)), None)


def parse_document(xml: str | None) -> dict:
    """The fields of PARSED; malformed XML gives an error and nulls."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError as e:
        return {"error": f"malformed XML: {e}"}
    header, body = _first(root, "teiHeader"), _first(root, "body")
    authors = _all(header, "sourceDesc", "author") or _all(header, "author")
    affiliations = [t for a in _all(header, "affiliation") for t in [" ".join(_text(a).split())] if t]
    ids = {x.get("type", "").lower(): _text(x) for x in _all(header, "idno")}
    date = next((d.get("when") for d in _all(header, "date") if d.get("when")), None)
    divs = []
    for k, div in enumerate(x for x in (list(body) if body is not None else []) if _tag(x) == "div"):
        head = next((c for c in div if _tag(c) == "head"), None)
        parts = [_text(c) for c in div if _tag(c) != "head"]
        divs.append({"div_pos": k, "head": _text(head) if head is not None else None, "body": "\n".join(p for p in parts if p).strip()})
    refs, pages = [], set()
    for x in _all(root, "biblStruct"):
        page = (x.get("coords") or "").split(",")[0]
        if page.strip().isdigit():
            pages.add(int(page))
    for k, x in enumerate(_all(root, "listBibl", "biblStruct")):
        when = next((d.get("when") for d in _all(x, "date") if d.get("when")), None)
        doi = next((_text(i) for i in _all(x, "idno") if i.get("type", "").lower() == "doi"), None)
        refs.append({"ref_pos": k, "title": _text(_first(x, "title")) or None, "authors": [n for a in _all(x, "author") if (n := _name(a))], "year": when, "doi": doi})
    return {
        "error": None, "title": _text(_first(header, "titleStmt", "title")) or None, "authors": [n for a in authors if (n := _name(a))], "affiliations": list(dict.fromkeys(affiliations)),
        "abstract": _text(_first(header, "abstract")), "keywords": [t for x in _all(header, "keywords", "term") if (t := _text(x))], "publication_date": date,
        "doi": ids.get("doi"), "pmid": ids.get("pmid"), "pmc": ids.get("pmc"), "body": "".join(body.itertext()) if body is not None else "", "page_count": len(pages) or None, "divs": divs, "refs": refs,
    }


def parse_documents(raw: DataFrame) -> DataFrame:
    """(paper_id, xml) to paper_id and the fields of PARSED. A malformed document is a row with an error."""
    fields = [f.split(" ")[0] for f in ("error title authors affiliations abstract keywords publication_date doi pmid pmc body page_count divs refs").split(" ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [parse_document(x) for x in batch["xml"]]
            out = pd.DataFrame({"paper_id": batch["paper_id"].to_numpy(), **{f: pd.Series([r.get(f) for r in rows], dtype=object) for f in fields}})
            yield out

    parsed = raw.select("paper_id", "xml").mapInPandas(run, f"paper_id string, {PARSED}")
    return parsed.withColumn("word_count", word_count(F.col("body")))


def divisions(parsed: DataFrame) -> DataFrame:
    return parsed.select("paper_id", F.inline("divs"))


def references(parsed: DataFrame) -> DataFrame:
    return parsed.select("paper_id", F.inline("refs"))


def guard(parsed: DataFrame, text_col: str = "body", least: int = Settings.min_document_chars) -> DataFrame:
    """parsed with reject: null for documents that go on, else the reason."""
    text = F.coalesce(text_col, F.lit(""))
    reason = F.when(F.trim(text) == "", F.lit("empty")).when(F.length(text) < least, F.lit("too short"))
    return parsed.withColumn("reject", reason)
