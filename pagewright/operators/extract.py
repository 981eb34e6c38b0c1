"""Objects to page texts: sniff, extract, number, classify."""

from __future__ import annotations

from typing import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import is_pdf, strip_nul, squash_ws

# HTML cleanup rules of the built-in extractor, applied in this
# order.  Comments, script and style blocks go first, then every tag becomes
# a space, then the named entities below are decoded ('&amp;' last).
HTML_DROP = [r"(?s)<!--.*?-->", r"(?is)<script[^>]*>.*?</script\s*>", r"(?is)<style[^>]*>.*?</style\s*>"]
HTML_TAG = r"<[^>]*>"
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                 ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
# Fixed value: a PDF-marked file whose markup never closes is treated as a
# truncated (corrupted) file.
HTML_END = "</html>"


def html_text(content) -> Column:
    """Visible text of an HTML document, whitespace squashed (native regex)."""
    c = F.col(content) if isinstance(content, str) else content
    c = c.cast("string")
    for pattern in HTML_DROP:
        c = F.regexp_replace(c, pattern, " ")
    c = F.regexp_replace(c, HTML_TAG, " ")
    for entity, char in HTML_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return squash_ws(c)


def builtin_extract(objects: DataFrame, content: str = "content") -> DataFrame:
    """Built-in extractor for the test objects: the text after the PDF marker
    is HTML; it yields one page.  Adds ``texts`` (array) and ``extract_error``."""
    # The header line (e.g. "%PDF-1.7") is not page text.
    body = F.regexp_replace(F.col(content).cast("string"), r"^%PDF-[0-9.]*", "")
    broken = ~F.lower(body).contains(HTML_END)
    return (objects
            .withColumn("extract_error", F.when(broken, F.lit("truncated")))
            .withColumn("texts", F.when(~broken, F.array(html_text(body)))))


class CorruptedFile(Exception):
    """Raised by an extractor or page counter for a file that cannot be opened."""


def extract_pages(objects: DataFrame, extractor: Callable[[bytes], list[str]], content: str = "content",
                  page_count: Callable[[bytes], int] | None = None) -> DataFrame:
    """Run a supplied extractor (bytes -> page texts, raising on a bad file)
    over the objects, an Arrow batch at a time.  Adds ``texts``,
    ``extract_error``, ``corrupted`` (the file could not be opened) and
    ``n_pages``; file bytes stay on the executors.

    ``page_count`` (bytes -> pages) is asked first, as the number of pages is
    known before their texts; when it fails the file counts as corrupted."""
    out_schema = T.StructType(list(objects.schema.fields) + [
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("extract_error", T.StringType()),
        T.StructField("corrupted", T.BooleanType()),
        T.StructField("n_pages", T.IntegerType()),
    ])

    def one(raw: bytes):
        pages = None
        try:
            if page_count is not None:
                try:
                    pages = int(page_count(raw))
                except Exception as exc:
                    raise CorruptedFile(str(exc)) from exc
            texts = list(extractor(raw))
            return texts, None, False, len(texts) if pages is None else pages
        except Exception as exc:  # the file, not the job, failed
            return None, f"{type(exc).__name__}: {exc}", isinstance(exc, CorruptedFile), pages

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            done = [one(bytes(raw) if raw is not None else b"") for raw in pdf[content]]
            texts, errors, corrupted, pages = zip(*done) if done else ((), (), (), ())
            yield pdf.assign(texts=list(texts), extract_error=list(errors), corrupted=list(corrupted),
                             n_pages=pd.array(list(pages), dtype="Int32"))

    return objects.mapInPandas(run, out_schema)


def ingest_status(pdf: Column, extract_error: Column) -> Column:
    """'unsupported_file_type' unless a PDF, 'corrupted_file' when extraction
    failed, else NULL."""
    return (F.when(~pdf, F.lit("unsupported_file_type"))
            .when(extract_error.isNotNull(), F.lit("corrupted_file")))


def number_pages(df: DataFrame, texts: str = "texts", from_page: str = "from_page",
                 inode_id: str = "id") -> DataFrame:
    """One row per page text: ``index = from_page + position`` and NUL-free
    contents.  ``posexplode`` keeps the work inside the partition."""
    return (df.select(F.col(inode_id).alias("inode_id"), F.col(from_page).alias("_from"),
                      F.posexplode(F.col(texts)).alias("_pos", "_text"))
            .select("inode_id", (F.col("_from") + F.col("_pos")).cast("int").alias("index"),
                    strip_nul("_text").alias("contents")))


def chunk_texts(text, size: int = 1000) -> Column:
    """Cut a text into consecutive ``size``-character pages."""
    t = F.col(text) if isinstance(text, str) else text
    n = F.ceil(F.length(t) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(t, k * size + 1, size))


__all__ = ["CorruptedFile", "html_text", "builtin_extract", "extract_pages", "ingest_status", "number_pages", "chunk_texts",
           "is_pdf"]
