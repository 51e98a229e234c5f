"""Secrets in texts: fixed patterns, and high-entropy tokens judged by how many owners hold the same one."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import join_hot, stored
from logweave.llm.words import LOWER, slices, text_bytes

# Fixed patterns of the base kinds, in this order; a match counts if its value is at least so long.
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "token")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# The added kind: long tokens with capitals, small letters and digits, and many different characters.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
TOKEN_LENGTH = 20
TOKEN_ENTROPY = 3.5

_CLASS = {
    "hex": np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8)),
    "token": np.isin(
        np.arange(256),
        np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", np.uint8),
    ),
}
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def entropy(value: str) -> float:
    """Bits per character by the value's own character frequencies."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _texts_with_run(data: np.ndarray, offsets: np.ndarray, kind: str, least: int) -> set[int]:
    """Numbers of the texts with a run of at least ``least`` bytes of the kind (a run over a border counts for both)."""
    inside = np.concatenate([[False], _CLASS[kind][data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    first = np.searchsorted(offsets, begin[long], "right") - 1
    last = np.searchsorted(offsets, end[long] - 1, "right") - 1
    return {k for a, b in zip(first.tolist(), last.tolist(), strict=True) for k in range(a, b + 1)}


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base kinds in code points, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found)


def token_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """High-entropy tokens outside the base spans."""
    out = []
    for m in TOKEN.finditer(text):
        value = m[0]
        mixed = any(c.isupper() for c in value) and any(c.islower() for c in value) and any(c.isdigit() for c in value)
        if mixed and entropy(value) >= TOKEN_ENTROPY and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            out.append((m.start(), 3, m.end(), value))
    return out


def _scan(column: pa.Array) -> Iterator[list[tuple[int, int, int, str]]]:
    """Spans of each text. Cheap tests on the bytes leave the patterns to the texts that can match."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets, 4 << 20):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        likely = _texts_with_run(part, at, "hex", LEAST["hex"]) | _texts_with_run(part, at, "token", TOKEN_LENGTH)
        lower, raw = LOWER[part].tobytes(), part.tobytes()
        for k in range(j - i):
            a, b = int(at[k]), int(at[k + 1])
            if k in likely or raw.find(b"AKIA", a, b) >= 0 or any(lower.find(w, a, b) >= 0 for w in _WORDS):
                text = raw[a:b].decode()
                base = base_spans(text)
                yield base + token_spans(text, base)
            else:
                yield []


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """One row per row of ``docs``: id, owner, repo, row tag and spans (start, kind, end, SHA-256 of the value)."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col).cast("string").alias("repo"),
        F.monotonically_increasing_id().alias("tag"),
        F.col(text_col).cast("string").alias("text"),
    )
    span = pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64()), ("hash", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [
                    {"start": s, "kind": k, "end": e, "hash": hashlib.sha256(value.encode()).hexdigest()}
                    for s, k, e, value in found
                ]
                for found in _scan(batch["text"])
            ]
            columns = [batch[c] for c in ("id", "owner", "repo", "tag")] + [pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "owner", "repo", "tag", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, owner string, repo string, tag long"
    return rows.mapInArrow(run, f"{shape}, spans array<struct<start:long,kind:long,end:long,hash:string>>")


def ownership(spans: DataFrame) -> DataFrame:
    """Distinct owners and repositories, and occurrences, of each candidate value (hash, owner, repo). A null owner or
    repository is one of its own. Distinct pairs are found with partial aggregates, so a value that everyone copies is
    reduced in the map tasks and by (value, owner) before it meets in one row."""
    pairs = spans.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    by_repo = pairs.groupBy("hash", "repo").agg(F.lit(1).alias("one"))
    owners = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("n"))
    repos = by_repo.groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.join(repos, "hash")


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    example_owners: int = 3,
    example_repos: int = 100,
) -> DataFrame:
    """Spans of each row of ``docs``: id and spans, an array of (start, kind, end, hash, owners, repositories, live).

    A value that ``example_owners`` or more owners or ``example_repos`` or more repositories hold is a copied example, any
    other is a live-looking credential of its owner. Base kinds are always reported; added high-entropy tokens only while they are live. Offsets are code
    points, the end exclusive. Null and empty texts have no spans; repeated rows are rows of their own; an empty table
    gives no rows; other columns are not read.
    """
    rows = stored(candidates(docs, id_col, text_col, owner_col, repo_col), "secret-candidates")
    spans = stored(rows.select("tag", "owner", "repo", F.explode("spans").alias("span")).select("*", "span.hash"), "secret-spans")
    held = stored(ownership(spans), "secret-owners")
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_repos)
    judged = join_hot(spans, held, ["hash"], "n").filter(live | (F.col("span.kind") < KINDS.index("token")))
    entry = F.struct("span.start", "span.kind", "span.end", "hash", "owners", "repositories", live.alias("live"))
    per_row = judged.groupBy("tag").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    out = rows.select("id", "tag").join(per_row, "tag", "left")
    none = F.array().cast(per_row.schema["found"].dataType)
    return out.select(F.col("id").alias(id_col), F.coalesce("found", none).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(one, ",")
