"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and links between tokens that overlap.

Tasks tokenise and align portions of documents: a byte-level BPE (A) and a piece BPE with byte fallback (B), each distinct
word of a portion once. Both sides' tokens end at byte offsets; ends that both have cut the bytes into groups, and between
two neighbouring ends of either side one token of A and one of B overlap, which is a link. Words are cut where tokens of
both sides begin anew, so groups and links of a document are those of its words behind each other.

Spark counts in how many documents a pair of ids is linked. Pairs that make a fixed share of all are few by counting and
are broadcast; the others, each in few documents, are joined by key, so no pair gathers its documents in one task.

Texts that are null or empty, or that a tokenizer doesn't give back byte by byte, have no tokens: zeros, no group string.
Texts of any length are aligned whole, rows may repeat and each is a document, an empty table gives no rows, and other
columns are left behind.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import cut
from paceline.llm.workers import portions, tidy

#: Where the vocabularies are on the driver; tasks get them from it.
VOCABULARIES = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are tokenised and aligned at once.
PORTION = 1 << 21
#: A pair that makes more than one in so many linked pairs is broadcast.
OFTEN = 100_000

#: links holds a * 2^32 + b of each linked pair of occurrences.
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>"
# How A splits text before merging, and where words can be cut apart for either tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
APART = re.compile(r"(?s)(?<=[!-~]) (?=.)")


def byte_of_letter() -> dict[str, int]:
    """The bytes that letters of a byte-level vocabulary stand for: printable ones for themselves, the others for the
    letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(other)}}


def _upto(n: np.ndarray) -> np.ndarray:
    """Running sums with a 0 before them."""
    return np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


def _sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of x over parts of these lengths."""
    return np.diff(_upto(x)[_upto(counts)])


def _behind(flat: np.ndarray, n: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The parts of `flat` with these numbers behind each other; n has the lengths of all parts."""
    begin, take = _upto(n)[codes], n[codes]
    upto = _upto(take)
    return flat[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], take)]


def _joined(pieces: pa.LargeBinaryArray, n: np.ndarray) -> pa.LargeBinaryArray:
    """Strings of so many pieces each."""
    _, at, held = pieces.buffers()
    cuts = np.frombuffer(at, np.int64)[_upto(n)] if len(pieces) else np.zeros(len(n) + 1, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(cuts), held])


class Pair:
    """Both tokenizers in a worker. Texts are cut at single spaces behind a printable ASCII character, at which tokens of
    either side begin anew, and each distinct word of a portion is tokenised once."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken

        model, letters = json.loads(a), byte_of_letter()
        special = {x["content"] for x in model["added_tokens"] if x["special"]}
        vocabulary = model["model"]["vocab"]
        merged = [(m if isinstance(m, str) else " ".join(m)).replace(" ", "") for m in model["model"]["merges"]]
        if any(vocabulary[m] != 256 + k for k, m in enumerate(merged)) or len(vocabulary.keys() - special) != 256 + len(merged):
            raise ValueError("ids of A don't follow its merges")
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces of B span words")
        a_bytes = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_bytes, self.b_bytes = (pa.array(t, pa.large_binary()) for t in (a_bytes, b_bytes))
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (a_bytes, b_bytes))
        # decimal ids as in a group string: before a token of the same side and group, or behind the last one
        spelt = [b"%d%s" % (i, sign) for n, last in ((len(a_bytes), b"|"), (len(b_bytes), b";")) for i in range(n) for sign in (b",", last)]
        self.spelt = pa.array(spelt, pa.large_binary())

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Numbers of the words of all texts behind each other, and how many each text has; none where either side doesn't
        give the text back. Of each side the ids of all distinct words, and how many each word has; none where either
        side doesn't give the word back."""
        parts = [APART.split(t) if t else [] for t in texts]
        every, counts = list(chain.from_iterable(parts)), np.array([len(x) for x in parts], np.int64)
        number = {w: k for k, w in enumerate(dict.fromkeys(every))}
        codes = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
        spaced = [" " + w for w in number]
        whole, sides = np.ones(len(number), bool), []
        for lists, table in ((list(map(self.a.encode_ordinary, spaced)), self.a_bytes), (self.b.encode(list(number), num_threads=1), self.b_bytes)):
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(chain.from_iterable(lists), np.int32, int(n.sum()))
            whole &= pc.equal(_joined(table.take(pa.array(ids)), n), pa.array(spaced, pa.large_string()).cast(pa.large_binary())).to_numpy(zero_copy_only=False).astype(bool)
            sides.append((ids, n))
        wrong, at = _upto(~whole[codes]), _upto(counts)
        good = wrong[at[1:]] == wrong[at[:-1]]
        return codes[np.repeat(good, counts)], counts * good, [(ids[np.repeat(whole, n)], n * whole) for ids, n in sides]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each side the ids of all texts behind each other, and how many each text has; none where either side
        doesn't give the text back."""
        codes, counts, sides = self.words(texts)
        return [(_behind(ids, n, codes), _sums(n[codes], counts)) for ids, n in sides]

    def align(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray]:
        """Of each text the numbers of tokens of A, of B and of groups, and the hash of its groups; the links of all texts
        behind each other, and how many each text has."""
        codes, counts, ((a, n_a), (b, n_b)) = self.words(texts)
        # distinct words behind each other have as many bytes on either side, so that their ends can be compared
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.sort(np.concatenate([a_end, b_end]), kind="stable")
        ends = ends[np.diff(ends, prepend=0) > 0]
        a_at, b_at = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        links = a[a_at].astype(np.int64) << 32 | b[b_at]
        both = (a_end[a_at] == ends) & (b_end[b_at] == ends)
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[a_at[both]], b_last[b_at[both]] = True, True
        n_groups = _sums(a_last, n_a)
        n_links = n_a + n_b - n_groups
        # a group has its tokens of A, then those of B: each stands behind the other side's tokens of the groups before
        a_cuts, b_cuts = _upto(np.diff(np.flatnonzero(a_last), prepend=-1)), _upto(np.diff(np.flatnonzero(b_last), prepend=-1))
        spelt = np.empty(len(a) + len(b), np.int64)
        spelt[np.arange(len(a)) + b_cuts[np.cumsum(a_last) - a_last]] = 2 * a.astype(np.int64) + a_last
        spelt[np.arange(len(b)) + a_cuts[np.cumsum(b_last) - b_last + 1]] = 2 * (len(self.a_size) + b.astype(np.int64)) + b_last
        groups = _joined(_joined(self.spelt.take(pa.array(spelt)), n_a + n_b).take(pa.array(codes)), counts)
        at, held = np.frombuffer(groups.buffers()[1], np.int64), memoryview(groups.buffers()[2] or b"")
        shas = [hashlib.sha256(held[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return [_sums(n[codes], counts) for n in (n_a, n_b, n_groups)], shas, _behind(links, n_links, codes), _sums(n_links[codes], counts)


_pairs: dict[int, Pair] = {}


def pair_of(files: tuple[bytes, bytes]) -> Pair:
    """The tokenizers of these files, built once in a worker."""
    key = hash(files)
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = Pair(*files)
    return _pairs[key]


def aligned(docs: DataFrame, vocabularies: str = VOCABULARIES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links) of each document."""
    read = lambda name: open(os.path.join(vocabularies, name), "rb").read()  # noqa: E731, SIM115
    files = docs.sparkSession.sparkContext.broadcast((read(A_FILE), read(B_FILE)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(files.value)
        for batch in portions(batches, "text", PORTION):
            numbers, shas, links, n = pair.align([t or "" for t in batch.column("text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(_upto(n), pa.int32()), pa.array(links))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, numbers), pa.array(shas, pa.string()), lists], names=[x.split()[0] for x in ALIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(apply), ALIGNED)


def pair_counts(held: DataFrame) -> DataFrame:
    """(link, n, best): in how many documents a pair is linked, and the highest count of its A id. One row for each pair
    that occurs, at most the product of the vocabularies."""
    n = held.select(F.explode(F.array_distinct("links")).alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n"))
    n = cut(n)
    best = n.groupBy(F.shiftright("link", 32).alias("id")).agg(F.max("n").alias("best"))
    return n.join(best, F.shiftright(n["link"], 32) == best["id"]).drop("id")


def align(docs: DataFrame, vocabularies: str = VOCABULARIES, often: int = OFTEN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    held = cut(aligned(docs, vocabularies).withColumn("row", F.monotonically_increasing_id()))
    counts = cut(pair_counts(held))
    least = (counts.agg(F.sum("n")).first()[0] or 0) // often
    one = held.select("row", F.explode("links").alias("link"))
    per = lambda d: d.groupBy("row").agg(F.count(F.lit(1)).alias("k"), F.sum(F.when(F.col("n") == F.col("best"), 1).otherwise(0)).alias("best"), F.sum("n").alias("sum"))
    # at most `often` pairs have more than their share of all counts
    joined = one.join(F.broadcast(counts.filter(F.col("n") > least)), "link", "left")
    common = per(joined.filter("n is not null"))
    rare = per(one.join(F.broadcast(counts.filter(F.col("n") > least).select("link")), "link", "left_anti").join(counts.filter(F.col("n") <= least), "link"))
    found = common.unionByName(rare).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("k", "best", "sum")))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    d = held.drop("links").join(found, "row", "left")
    return d.select("doc_id", "n_a", "n_b", "n_groups", zero("k", "n_links"), zero("best", "n_best"), zero("sum", "count_sum"), "groups_sha256")
