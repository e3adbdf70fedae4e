"""Byte-level BPE over whole texts by monoid tree reduction.

A text is halved recursively down to leaves; each leaf becomes an element of a
monoid and neighbours are joined up the tree.  What makes the join exact is a
*seam*: a place where a non-blank character is followed by a blank.  Every
match of the splitting pattern holds blanks only at its beginning, or nothing
but blanks, and looks one character ahead only after blanks; so no match
crosses a seam and no match before a seam depends on what follows it.  Tokens
between two seams are therefore the same in every text that holds them.

An element is ``Open`` (a text without a seam, not yet encoded) or ``Closed``
(the text before its first seam, the final ids between its first and its last
seam, the text from its last seam on).  To join two elements, only the window
between the last seam of the left one and the first seam of the right one is
encoded; if there is none, the window grows over the neighbour and the next
join tries again.  ``Open("")`` is the identity, and the join is associative,
so any tree gives the ids of the whole text.  Decoding is the monoid of byte
strings: leaves of ids are looked up and concatenated up the same tree.

Texts of more than ``piece_chars`` characters are cut into pieces that Spark
deals over the cluster; the pieces' elements meet again by one exchange of
those texts alone.  All others are reduced where they are read.

Defined cases: a null text is empty and has no ids; equal rows are encoded each
for itself; further columns are ignored; an empty table gives an empty result;
a null doc_id is kept.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import pick

LEAF_CHARS = 8_192
PIECE_CHARS = 65_536
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"
#: The character before is a blank for no library, the one after is one for all.
_SEAM = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \t\n\r]")


@cache
def encoding(path: str, pattern: str):
    """The tokenizer of a rank file, once for each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def vocabulary(path: str, pattern: str) -> dict[int, bytes]:
    return {rank: token for token, rank in encoding(path, pattern)._mergeable_ranks.items()}


@dataclass(frozen=True)
class Open:
    text: str


@dataclass(frozen=True)
class Closed:
    head: str
    ids: np.ndarray
    tail: str


Element = Open | Closed
Encode = Callable[[str], np.ndarray]


def leaf(text: str, encode: Encode) -> Element:
    first = _SEAM.search(text)
    if first is None:
        return Open(text)
    last = _last_seam(text)
    return Closed(text[: first.start()], encode(text[first.start() : last]), text[last:])


def _last_seam(text: str) -> int:
    """Where the last blank after a non-blank is; the text has one."""
    end = len(text)
    while True:
        start = max(0, end - 512)
        found = [m.start() for m in _SEAM.finditer(text, max(0, start - 1), end)]
        if found or not start:
            return found[-1]
        end = start + 1


def join(a: Element, b: Element, encode: Encode) -> Element:
    """The element of the concatenated texts."""
    if isinstance(a, Closed) and isinstance(b, Closed):
        return Closed(a.head, np.concatenate([a.ids, encode(a.tail + b.head), b.ids]), b.tail)
    left = a.text if isinstance(a, Open) else a.tail
    right = b.text if isinstance(b, Open) else b.head
    seam = _SEAM.search(left[-1:] + right[:1]) is not None
    if isinstance(a, Closed):
        return Closed(a.head, np.concatenate([a.ids, encode(left)]), right) if seam else Closed(a.head, a.ids, left + right)
    if isinstance(b, Closed):
        return Closed(left, np.concatenate([encode(right), b.ids]), b.tail) if seam else Closed(left + right, b.ids, b.tail)
    return Closed(left, np.zeros(0, np.int64), right) if seam else Open(left + right)


def ids_of(element: Element, encode: Encode) -> np.ndarray:
    if isinstance(element, Open):
        return encode(element.text)
    return np.concatenate([encode(element.head), element.ids, encode(element.tail)])


def reduce_tree(elements: list[Element], encode: Encode) -> Element:
    """Neighbours joined level by level."""
    while len(elements) > 1:
        elements = [join(*elements[i : i + 2], encode) if i + 1 < len(elements) else elements[i] for i in range(0, len(elements), 2)]
    return elements[0] if elements else Open("")


def element_of(text: str, encode: Encode, leaf_chars: int = LEAF_CHARS) -> Element:
    """The element of a text, its halves encoded recursively."""
    if len(text) <= leaf_chars:
        return leaf(text, encode)
    half = len(text) // 2
    return join(element_of(text[:half], encode, leaf_chars), element_of(text[half:], encode, leaf_chars), encode)


def decode(ids: np.ndarray, words: dict[int, bytes], leaf_ids: int = 4_096) -> bytes:
    """Bytes of the ids: leaves looked up, then concatenated up the tree."""
    parts = [b"".join(map(words.__getitem__, ids[i : i + leaf_ids].tolist())) for i in range(0, len(ids), leaf_ids)]
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else b""


def _encoder(path: str, pattern: str) -> Encode:
    own = encoding(path, pattern)
    return lambda text: np.asarray(own.encode_ordinary(text), dtype=np.int64) if text else np.zeros(0, np.int64)


def _digest(ids: np.ndarray, words: dict[int, bytes]) -> tuple[int, str, str, int]:
    raw = decode(ids, words)
    return len(ids), hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), len(raw)


def encode_documents(docs: DataFrame, path: str, pattern: str, piece_chars: int = PIECE_CHARS, digest: bool = True) -> DataFrame:
    """Encode and decode every text: SCHEMA, or with ``digest=False`` doc_id, ids (array) and decoded (binary)."""
    schema = SCHEMA if digest else "doc_id long, ids array<int>, decoded binary"
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(keys: list, ids: list[np.ndarray]) -> dict[str, list]:
        words = vocabulary(path, pattern)
        if not digest:
            return {"doc_id": keys, "ids": ids, "decoded": [decode(x, words) for x in ids]}
        return dict(zip(names, [keys, *map(list, zip(*(_digest(x, words) for x in ids)))])) if keys else {n: [] for n in names}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern)
        types = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64())] if digest else [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = [ids_of(element_of(t.as_py(), encode), encode) for t in part.column(1)]
                yield pa.RecordBatch.from_pydict(rows(part.column(0).to_pylist(), ids), types)

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path, pattern)
        for f in frames:
            made = [element_of(t, encode) for t in f["piece"]]
            yield pd.DataFrame({
                "row": f["row"], "doc_id": f["doc_id"], "at": f["at"],
                "head": [e.text if isinstance(e, Open) else e.head for e in made],
                "tail": [None if isinstance(e, Open) else e.tail for e in made],
                "ids": [b"" if isinstance(e, Open) else e.ids.astype("<u4").tobytes() for e in made],
            })

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        encode = _encoder(path, pattern)
        f = f.sort_values("at")
        made: list[Element] = [Open(h) if t is None else Closed(h, np.frombuffer(i, "<u4").astype(np.int64), t) for h, t, i in zip(f["head"], f["tail"], f["ids"])]
        out = pd.DataFrame(rows([f["doc_id"].iloc[0]], [ids_of(reduce_tree(made, encode), encode)]))
        return out.astype({"doc_id": "Int64"})

    short = d.where(F.length("text") <= piece_chars).mapInArrow(whole, schema)
    n = F.ceil(F.length("text") / F.lit(piece_chars)).cast("int")
    long = d.where(F.length("text") > piece_chars).withColumn("row", F.monotonically_increasing_id())
    long = long.select("row", "doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    long = long.select("row", "doc_id", "at", F.substring("text", F.col("at") * piece_chars + 1, F.lit(piece_chars)).alias("piece"))
    long = long.repartition("row", "at").mapInPandas(pieces, "row long, doc_id long, at int, head string, tail string, ids binary")
    return short.unionByName(long.groupBy("row").applyInPandas(meet, schema))
