"""Fill-in-the-middle transformation by secondary sort.

A text of n code points is cut into prefix, middle and suffix by numbers drawn
from a hash of its id, and put together in another order behind marks.  No task
builds a whole output: every text becomes pieces of at most ``UNIT`` code points,
keyed by document and position in the output.  One exchange by document and a
sort by (document, position) inside each partition (``repartition`` and
``sortWithinPartitions``, the DataFrame form of repartitionAndSortWithinPartitions)
stream the pieces into an incremental digest.

Restoration sees the sorted output alone: it finds the marks in the stream, also
where one lies across two pieces, names each part, and sorts the parts' pieces again
by (document, part, position), in the same partition without another exchange,
into the digest of the text that was.

Memory: a task holds one Arrow batch of texts or pieces and one digest; Spark's
sort spills.  Documents are dealt by hash, and one very long document is a stream
of pieces.

Defined cases: a null text is the empty one; a null doc_id draws from `1:` alone
and stays null.  Rows of one id and one text are one stream, and give as many equal
rows as there were.  An empty table gives an empty result.  Other columns, also those
whose names differ in case alone, do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import by_size, pick

#: Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that stay plain at least, and of the others that take the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SEED = "1"
#: Code points in a piece; bytes of text that are cut at a time.
UNIT, PART = 16_384, 4 << 20

_PIECES = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("position", pa.int64()), ("form", pa.string()), ("piece", pa.string())])
_PARTS = pa.schema([
    ("key", pa.binary()), ("part", pa.int32()), ("position", pa.int64()), ("piece", pa.string()),
    ("doc_id", pa.int64()), ("copies", pa.int64()), ("form", pa.string()), ("output_sha256", pa.string()),
])
_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("output_sha256", pa.string()), ("restored_sha256", pa.string()),
])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def plan(doc_id: int | None, text: str) -> tuple[str, int, int]:
    """(form, where the prefix ends, where the middle ends) of a text."""
    n = len(text)
    h = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not n or h3 % 100 >= 100 - PLAIN or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", n, n
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < SUFFIX_FIRST else "psm", a, b


def _output(text: str, form: str, a: int, b: int) -> Iterator[str]:
    """The output in pieces: marks stand at the head of the part they name, as text like any other."""
    parts = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text))}
    for mark in {"plain": ("",), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}[form]:
        lo, hi = parts.get(mark, (0, len(text)))
        yield mark + text[lo : min(hi, lo + UNIT)]
        for i in range(lo + UNIT, hi, UNIT):
            yield text[i : min(hi, i + UNIT)]


def _batches(rows: Iterator[tuple], schema: pa.Schema, wide: int, most: int = 1 << 22, most_rows: int = 8_192) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about ``most`` characters in column ``wide``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[wide] or "")
        if size >= most or len(held) >= most_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def pieces(docs: DataFrame) -> DataFrame:
    """(key, doc_id, position, form, piece): every output in pieces; those of one key in order of position are its text.

    Rows of one id and one text have one key, and so the same pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in by_size(batches, "text", PART):
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"]):
                    text = text.as_py()
                    key = hashlib.blake2b(f"{doc}:".encode() + text.encode(), digest_size=16).digest()
                    form, a, b = plan(doc, text)
                    position = 0
                    for piece in _output(text, form, a, b):
                        yield key, doc, position, form, piece
                        position += len(piece)

        return _batches(rows(), _PIECES, 4)

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.mapInArrow(cut, _ddl(_PIECES))


class _Output:
    """One output as it streams by: its digest, and its parts as the marks tell them apart."""

    _ORDER = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

    def __init__(self, key: bytes, doc_id: int | None, form: str):
        self.key, self.doc_id, self.form, self.copies = key, doc_id, form, 0
        self.digest, self.held, self.part, self.position, self.begun = hashlib.sha256(), "", 0, 0, False

    def feed(self, piece: str, last: bool = False) -> Iterator[tuple]:
        """(part, position, text) of what is now sure; a tail that may begin a mark waits for the next piece."""
        self.digest.update(piece.encode())
        text = self.held + piece
        at = 0
        if self.form != "plain":
            for i in self._marks(text):
                yield from self._some(text[at:i])
                self.part, at = self._ORDER[text[i : i + 3]], i + 3
        wait = 0 if last or self.form == "plain" else next((k for k in (2, 1) if len(text) - at >= k and any(m.startswith(text[-k:]) for m in self._ORDER)), 0)
        yield from self._some(text[at : len(text) - wait])
        self.held = text[len(text) - wait :]

    def _marks(self, text: str) -> list[int]:
        return sorted(i for m in self._ORDER if (i := text.find(m)) >= 0)  # each stands once in an output

    def _some(self, text: str) -> Iterator[tuple]:
        if text:
            yield self.part, self.position, text
            self.position += len(text)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of outputs to pieces of named parts; a last row of part 3 carries what is known of the output."""

    def rows():
        now: _Output | None = None
        seen = -1
        for batch in batches:
            for key, doc, position, form, piece in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if now is None or key != now.key:
                    if now is not None:
                        yield from end(now)
                    now, seen = _Output(key, doc, form), -1
                now.copies += not position
                if position > seen:  # pieces of equal rows stand side by side and are read once
                    seen = position
                    for part, at, text in now.feed(piece):
                        yield key, part, at, text, None, None, None, None
        if now is not None:
            yield from end(now)

    def end(o: _Output):
        for part, at, text in o.feed("", last=True):
            yield o.key, part, at, text, None, None, None, None
        yield o.key, 3, 0, None, o.doc_id, o.copies, o.form, o.digest.hexdigest()

    return _batches(rows(), _PARTS, 3)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of parts to one row per document."""

    def rows():
        digest, chars = hashlib.sha256(), [0, 0, 0]
        for batch in batches:
            for i, part in enumerate(batch.column(1).to_pylist()):
                if part < 3:
                    text = batch.column(3)[i].as_py()
                    digest.update(text.encode())
                    chars[part] += len(text)
                    continue
                doc, copies, form, output = (batch.column(c)[i].as_py() for c in range(4, 8))
                cuts = (None, None) if form == "plain" else (chars[0], chars[1])
                for _ in range(copies):
                    yield doc, sum(chars), form, *cuts, output, digest.hexdigest()
                digest, chars = hashlib.sha256(), [0, 0, 0]

    return _batches(rows(), _RESULT, 2)


def restore(found: DataFrame) -> DataFrame:
    """One row per document from ``pieces``: lengths, form, digests of the output and of the text rebuilt from it."""
    dealt = found.repartition("key").sortWithinPartitions("key", "position")
    parts = dealt.mapInArrow(_streamed, _ddl(_PARTS))
    return parts.sortWithinPartitions("key", "part", "position").mapInArrow(_restored, _ddl(_RESULT))


def transform(docs: DataFrame) -> DataFrame:
    """What ``restore`` tells of every document's pieces."""
    return restore(pieces(docs))


def outputs(docs: DataFrame) -> DataFrame:
    """(doc_id, form, position, piece) in order inside each partition: the outputs themselves, for a writer."""
    return pieces(docs).repartition("key").sortWithinPartitions("key", "position").select("key", "doc_id", "form", "position", "piece")
