"""Exact duplicates by Patricia tries.

Texts are dealt to partitions by length and content hash. There each length has a compressed radix
trie over hash and full text; a terminal node stores the id that owns the text and how many rows
share it. Rows come sorted by length and hash, so every subtree left of the current path is final:
once a trie holds more than TRIE_BYTES, those subtrees are spilled, as finished rows.

Before the shuffle each task runs its own rows through the same trie and sends a row for each distinct
text, so a group of copies of any size arrives as one row from each task.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.arrow import documents, one_of_each, saved

TRIE_BYTES = 24 << 20


class Node:
    __slots__ = ("children", "copies", "label", "owner", "rows")

    def __init__(self, label: bytes, owner: int | None = None, rows: int = 0, copies: int = 0):
        self.label, self.owner, self.rows, self.copies = label, owner, rows, copies
        self.children: dict[int, Node] = {}

    def take(self, owner: int | None, rows: int, copies: int, largest: bool) -> None:
        """Adds rows of this text; copies counts those that bear the owner's id."""
        if not self.rows or owner != self.owner and (self.owner is None or owner is not None and (owner > self.owner) == largest):
            self.owner, self.copies = owner, copies
        elif owner == self.owner:
            self.copies += copies
        self.rows += rows


class Trie:
    """A compressed radix trie of byte strings. Null ids own a text only if no other row has it."""

    def __init__(self, largest: bool = True):
        self.root, self.held, self.largest = Node(b""), 0, largest

    def insert(self, key: bytes, owner: int | None, rows: int = 1, copies: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = leaf = Node(key[at:])
                self.held += len(leaf.label)
                node, at = leaf, len(key)
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            same = len(os.path.commonprefix((child.label, key[at : at + len(child.label)])))
            fork = Node(child.label[:same])
            node.children[key[at]] = fork
            child.label = child.label[same:]
            fork.children[child.label[0]] = child
            node, at = fork, at + same
        node.take(owner, rows, copies, self.largest)

    def spill(self, current: bytes | None = None) -> Iterator[tuple[bytes, Node]]:
        """Removes and yields the terminal nodes off the path of `current`; without it, all."""
        node, at = self.root, 0
        while True:
            path = node.children.get(current[at]) if current is not None and at < len(current) else None
            for first in [k for k, x in node.children.items() if x is not path]:
                stack = [((current or b"")[:at], node.children.pop(first))]
                while stack:
                    prefix, x = stack.pop()
                    key = prefix + x.label
                    self.held -= len(x.label)
                    if x.rows:
                        yield key, x
                    stack += [(key, c) for c in x.children.values()]
            if path is None:
                break
            node, at = path, at + len(path.label)
        if current is None and self.root.rows:
            yield b"", self.root
            self.root.rows = 0


def _key(h: int, text: bytes) -> bytes:
    """The hash, so that bytes sort as the signed numbers do, and the text."""
    return (h + (1 << 63)).to_bytes(8, "big") + text


_PARTIAL = "length long, h long, content binary, owner long, n long, copies long"


def _partial(largest: bool, limit: int):
    def emit(tries: dict[int, Trie]) -> Iterator[pa.RecordBatch]:
        rows = [(n, int.from_bytes(k[:8], "big") - (1 << 63), k[8:], x.owner, x.rows, x.copies) for n, t in tries.items() for k, x in t.spill()]
        for i in range(0, len(rows), 2000):
            columns = zip(*rows[i : i + 2000], strict=True)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["length", "h", "content", "owner", "n", "copies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[int, Trie] = {}
        held = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                for n, h, content, owner in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns), strict=True):
                    trie = tries.setdefault(n, Trie(largest))
                    before = trie.held
                    trie.insert(_key(h, content), owner)
                    held += trie.held - before
                if held > limit:
                    yield from emit(tries)
                    tries, held = {}, 0
        yield from emit(tries)

    return run


_CLASSES = "text_sha256 string, keep_id long, group_size long, keep_copies long"


def _final(largest: bool, limit: int):
    def emit(found: list[tuple[bytes, Node]]) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(k[8:]).hexdigest() for k, _ in found], pa.string()),
                    *(pa.array([getattr(x, name) for _, x in found], pa.int64()) for name in ("owner", "rows", "copies")),
                ],
                names=["text_sha256", "keep_id", "group_size", "keep_copies"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, length = Trie(largest), None
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                for n, h, content, owner, rows, copies in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns), strict=True):
                    if n != length:
                        yield from emit(list(trie.spill()))
                        trie, length = Trie(largest), n
                    key = _key(h, content)
                    trie.insert(key, owner, rows, copies)
                    if trie.held > limit:
                        yield from emit(list(trie.spill(key)))
        yield from emit(list(trie.spill()))

    return run


def duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", largest: bool = True, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """A row for each distinct text: text_sha256, keep_id, group_size and keep_copies (rows that bear keep_id)."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.octet_length(content).cast("long").alias("length"), F.xxhash64(content).alias("h"), content.cast("binary").alias("content"), F.col(doc_id).cast("long").alias("owner")
    )
    partial = rows.mapInArrow(_partial(largest, trie_bytes), _PARTIAL)
    dealt = partial.repartition("length", "h").sortWithinPartitions("length", "h")
    return dealt.mapInArrow(_final(largest, trie_bytes), _CLASSES)


def mark_duplicates(docs: DataFrame, classes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of `docs` with text_sha256, keep_id, group_size, keep_copies and kept.

    A null text counts as empty. Of equal texts the row with the largest id stays; a null id only if no
    other row has the text. Rows that repeat the id that stays are all marked as kept. The join is split
    where a group of copies is large, as its other side has one row for each text.
    """
    taken = ("keep_id", "group_size", "keep_copies", "kept", "text_sha256")
    own = docs.drop(*taken).withColumn("text_sha256", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    return own.join(classes, "text_sha256").withColumn("kept", F.col(doc_id).cast("long").eqNullSafe(F.col("keep_id")))


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one for each distinct text, with their own columns."""
    classes = saved(duplicate_classes(docs, doc_id, text), "exact-classes")
    own = docs.columns
    renamed = docs.withColumnsRenamed({c: f"__own_{c}" for c in own})
    marked = mark_duplicates(renamed, classes, f"__own_{doc_id}", f"__own_{text}").withColumn("repeated", F.col("keep_copies") > 1)
    ties = bool(classes.filter("keep_copies > 1").limit(1).count())
    stay = one_of_each(marked, "kept", "repeated", ["text_sha256"], ties)
    return stay.select(*(F.col(f"__own_{c}").alias(c) for c in own))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; a null text counts as empty."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    marked = mark_duplicates(docs, duplicate_classes(docs))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
