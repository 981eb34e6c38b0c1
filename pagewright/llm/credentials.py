"""Secret scan that weighs candidates by who owns them across the corpus.

Each text is scanned once.  Candidates of the generators are reduced to a hash;
hashes are counted by distinct repositories and distinct owners over all
documents.  A value that many owners carry is a copied example; one that
stays with few owners and looks random is taken for a live credential.  Spans
of the base rules are reported whatever their class; the wider generators add
a span only when its value looks live.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from itertools import accumulate
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

# The base rules, in listed order.
BASE_KINDS = ("assign", "access", "hex")
BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
ASSIGN_LEAST = 6
# Wider generators: (kind, rule, group that holds the value; a match without the group only moves the scan on).
WIDER = (
    ("bearer", re.compile(r"""\b(?:bearer|authorization)(?:\x20*+[:=]\x20*+|\x20++)([A-Za-z0-9+/_.~=-]{16,})""", re.I | re.A), 1),
    ("prefixed", re.compile(r"\b(?:(?:ghp|gho|ghs|glpat|sk|pk|xox[abprs]|AIza)[_-][A-Za-z0-9_-]{16,}|AIza[A-Za-z0-9_-]{30,})", re.A), 0),
    # A run without two more segments is passed over at once: from a later 'eyJ' in it, it has none either.
    ("jwt", re.compile(r"\b(?:(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)|eyJ[A-Za-z0-9_-]{8,}+)"), 1),
    # A whole block; one without an end line goes on as far as its base64 lines do.
    ("pem", re.compile(r"-----BEGIN (?:(?!PRIVATE KEY)[A-Z0-9 ])*+PRIVATE KEY(?: BLOCK)?-----"
                       r"((?:[^-]++|-(?!----(?:BEGIN|END) ))*+(?=-----END (?:(?!PRIVATE KEY)[A-Z0-9 ])*+PRIVATE KEY(?: BLOCK)?-----)"
                       r"|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2}+)*+(?:(?:\s|\\[nr])++[A-Za-z0-9+/]++={0,2}+\s*+\Z)?+)"
                       r"(?:-----END [A-Z0-9 ]++-----)?+"), 1),
    ("keyed", re.compile(r"""\b(?:pwd|passphrase|credential|private_?key|client_?id|access_?key|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})""", re.I | re.A), 1),
)
KINDS = BASE_KINDS + tuple(k for k, _, _ in WIDER)
COPIED_OWNERS = 5       # from so many distinct owners on, a value is a copied example
LIVE_BITS = 3.0         # bits per character from which a value looks random
LIVE_LENGTH = 12
PEM_BREAK = re.compile(r"\\r|\\n|\r")                           # also as written in string literals
PEM_HEADER = re.compile(r"^[ \t\"']*+[A-Za-z0-9-]++: .*$", re.M)     # Proc-Type, DEK-Info, Version
PEM_LINE = re.compile(r"[A-Za-z0-9+/]{16,}+={0,2}+")


def randomness(value: str) -> float:
    """Shannon entropy of the characters, in bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in (value.count(ch) for ch in set(value))) if n else 0.0


def looks_random(value: str) -> bool:
    return (len(value) >= LIVE_LENGTH and randomness(value) >= LIVE_BITS
            and any(ch.isdigit() for ch in value) and any(ch.isalpha() for ch in value))


def pem_value(body: str) -> str:
    """The base64 lines of a block as one text, however it is wrapped or quoted."""
    return "".join(PEM_LINE.findall(PEM_HEADER.sub("", PEM_BREAK.sub("\n", body))))


def candidates(text: str) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, value hash, looks random) of every candidate, by start, then kind.

    Base rules: leftmost non-overlapping matches per kind, those that are too
    short dropped without a second try.  Wider candidates that overlap a base span are left out,
    but for key blocks: a base span holds a part of one at most ('secret: -----BEGIN').
    """
    found = []
    for kind in BASE_KINDS:
        for m in BASE[kind].finditer(text):
            value = m.group(2) if kind == "assign" else m.group()
            if kind != "assign" or len(value) >= ASSIGN_LEAST:
                found.append((kind, m.start(), m.end(), value))
    base = sorted((s, e) for _, s, e, _ in found)
    starts = [s for s, _ in base]
    reach = list(accumulate((e for _, e in base), max))      # furthest end so far
    for kind, rule, group in WIDER:
        for m in rule.finditer(text):
            value, before = m.group(group), bisect_left(starts, m.end())
            if value is not None and (kind == "pem" or not before or reach[before - 1] <= m.start()):
                found.append((kind, m.start(), m.end(), pem_value(value) if kind == "pem" else value))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return [(k, s, e, hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32], looks_random(v))
            for k, s, e, v in found]


FOUND = "array<struct<kind:string,start:bigint,end:bigint,hash:string,random:boolean>>"


def scan(docs: DataFrame, text_col: str, repo: Column, owner: Column, keep: list[str]) -> DataFrame:
    """Row number, ``keep`` columns, repository, owner and candidates of every row (text read once).

    The kept columns come back as u0, u1, ... in order, so no name of theirs can clash."""
    texts_at = f"u{keep.index(text_col)}" if text_col in keep else "_scanned"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f.pop("_scanned") if texts_at == "_scanned" else f[texts_at]
            f["_found"] = [[{"kind": k, "start": s, "end": e, "hash": h, "random": r} for k, s, e, h, r in candidates(t or "")]
                           for t in texts]
            yield f

    given = docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`").alias(f"u{i}") for i, c in enumerate(keep)],
                        repo.cast("string").alias("_repo"), owner.cast("string").alias("_owner"),
                        *([] if text_col in keep else [F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_scanned")]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields if f.name != "_scanned")
    return given.mapInPandas(run, f"{fields}, _found {FOUND}")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners, n_uses over the whole corpus.

    Pairs are made distinct first (combined map-side), so a value that a third
    of all rows carry is one row per task and repository before the count.
    """
    pairs = found.groupBy("hash", "_repo", "_owner").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy("hash").agg(F.countDistinct("_repo").alias("n_repos"), F.countDistinct("_owner").alias("n_owners"),
                                     F.sum("_n").alias("n_uses"))


def judged(at: DataFrame, copied_owners: int) -> DataFrame:
    """(_row, secrets) of the scanned rows that have any."""
    each = at.select("_row", "_repo", "_owner", F.explode("_found").alias("c")).select("_row", "_repo", "_owner", "c.*")
    verdict = ownership(each).select(F.col("hash").alias("_hash"), "n_repos", "n_owners")
    # One verdict row a value: the candidates of a very common value are split by the skew join.
    told = (each.drop("_repo", "_owner").join(verdict, F.col("hash") == F.col("_hash"))
            .withColumn("class", F.when(F.col("n_owners") >= copied_owners, "example")
                        .when(F.col("random"), "live").otherwise("unclear"))
            .where(F.col("kind").isin(*BASE_KINDS) | (F.col("class") == "live")))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct("start", order.alias("order"), "end", "kind", "hash", "class")
    return told.groupBy("_row").agg(F.array_sort(F.collect_list(item)).alias("secrets"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None,
                 owner: Column | None = None, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row per document: id and ``secrets``, an array by start, then kind, of
    (kind, start, end, hash, class), with class ``example`` (many owners),
    ``live`` (few owners, looks random) or ``unclear``.

    Base spans are always listed, wider ones only if ``live``.  A null or empty
    text has none; null repositories and owners are not counted as owners;
    repeated rows stay repeated; an empty table gives no rows; other columns
    are ignored.
    """
    own = owner if owner is not None else F.col("source")
    at = materialize(scan(docs, text_col, repo if repo is not None else own, own, [id_col]), "candidates")
    none = F.array().cast("array<struct<start:bigint,order:bigint,end:bigint,kind:string,hash:string,class:string>>")
    return (at.select("_row", "u0").join(judged(at, copied_owners), "_row", "left")
            .select(F.col("u0").alias(id_col), F.coalesce("secrets", none).alias("secrets")))


def redact_secrets(docs: DataFrame, text_col: str = "text", repo: Column | None = None, owner: Column | None = None,
                   copied_owners: int = COPIED_OWNERS, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all rows and columns, with every listed secret that is not a
    widely copied example replaced by ``mark``.

    Only rows with candidates are joined with their verdicts; the others pass.
    Null and empty texts stay as they are; so do repeated rows.  Columns may have
    any names; an empty table gives no rows.
    """
    own = owner if owner is not None else F.col("source")
    columns, text_at = [f"u{i}" for i in range(len(docs.columns))], f"u{docs.columns.index(text_col)}"
    at = materialize(scan(docs, text_col, repo if repo is not None else own, own, docs.columns), "scanned")
    clean = at.where(F.size("_found") == 0).select(*columns)
    told = judged(at, copied_owners).withColumn("secrets", F.filter("secrets", lambda s: s["class"] != "example"))
    text = F.when(F.size("secrets") > 0, redacted(F.col(text_at), F.col("secrets"), mark)).otherwise(F.col(text_at))
    changed = at.where(F.size("_found") > 0).join(told, "_row", "left").withColumn(text_at, text)
    return clean.unionByName(changed.select(*columns)).toDF(*docs.columns)


def redacted(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with every listed span, overlaps joined, replaced by ``mark``."""
    start = F.aggregate(secrets, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
                        lambda a, s: F.when(s["end"] <= a["at"], a).when(s["start"] < a["at"], F.struct(
                            a["out"].alias("out"), s["end"].alias("at"))).otherwise(F.struct(
                                F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                                         F.lit(mark)).alias("out"), s["end"].alias("at"))))
    return F.concat(start["out"], F.substring(text, (start["at"] + 1).cast("int"), F.length(text)))
