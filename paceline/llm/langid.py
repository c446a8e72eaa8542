"""Language identification: an interpolated Kneser-Ney character model for each language.

4-grams of the lower-cased code points (three boundary marks in front of each text) are counted over the training
documents; lower orders use continuation counts. Code points above U+FFFF are hashed into the private use area. Grams
are hashed into slots, SLOTS for each order over all languages and 2**SLOT_BITS for each language at most, which bounds
a model whatever the number of languages, and kept as sorted arrays of slots with their counts. The language with the
lowest cross-entropy for each character is predicted; ties go to the smaller name.

Every tenth training document, by a hash of doc_id, is not counted but held apart for calibration: for each language the
cross-entropy that all but REJECT of these documents stay under, taken over all of them, gives the limit beyond which a
text is rejected (a language without any such document: the loosest limit of the others). How sure a prediction is
depends on one number, fitted on CALIBRATION of the documents held apart.

Null texts and texts without a letter (Unicode category L) are `und`, score 0, rejected. Without any labelled text
nothing is learned: all is `und`, and only texts without a letter are rejected. Null doc_ids count as training
documents; repeated rows count each; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import cut
from paceline.llm.workers import portions, tidy

ORDER = 4
SLOT_BITS, SLOTS = 20, 1 << 22
CALIBRATION = 2000
#: Of labelled texts, this share is beyond the limit before the margin.
REJECT = 0.001
#: Texts are rejected from so many times that cross-entropy on.
MARGIN = 1.5

_MARK = "\x01" * (ORDER - 1)
_LETTER = re.compile(r"[^\W\d_]")
_CHARS = 1 << 19
#: Numbers that a worker remembers at most: log-probabilities of grams that it has met.
KNOWN = 1 << 20


def has_letter(text: str) -> bool:
    return any(unicodedata.category(m[0])[0] == "L" for m in _LETTER.finditer(text))


def _slots(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    mixed = (codes.astype(np.uint64) + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-grams of all characters of the texts, the text that each belongs to, and how many each has."""
    whole = _MARK + _MARK.join(texts)
    c = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
    if len(c) and c.max() > 0xFFFF:
        c = np.where(c > 0xFFFF, 0xE000 + ((c * np.uint32(2654435761)) >> np.uint32(16)) % 6400, c)
    c = c.astype(np.uint64)
    g = c[3:] | (c[2:-1] << np.uint64(16)) | (c[1:-2] << np.uint64(32)) | (c[:-3] << np.uint64(48))
    n = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(n[:-1] + 3)])
    keep = np.zeros(len(g) + 1, np.int8)
    np.add.at(keep, begins, 1)
    np.add.at(keep, begins + n, -1)
    return g[np.cumsum(keep[:-1]).astype(bool)].view(np.int64), np.repeat(np.arange(len(texts)), n), n


def _chunks(rows: Iterator[tuple], at: int) -> Iterator[list[tuple]]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[at])
        if n >= _CHARS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    sums: dict[str, pd.Series] = {}

    def add(lang: str) -> None:
        g = _codes(held.pop(lang))[0]
        k, names = pd.factorize(g)
        new = pd.Series(np.bincount(k, minlength=len(names)), index=names)
        sums[lang] = new if lang not in sums else sums[lang].add(new, fill_value=0)

    def out(lang: str) -> pa.RecordBatch:
        s = sums.pop(lang)
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(s), pa.string()), "code": pa.array(s.index.to_numpy(), pa.int64()), "n": pa.array(s.to_numpy().astype(np.int64))})

    for batch in portions(batches, "text", _CHARS):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                held.setdefault(lang, []).append(text.lower())
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= 4 * _CHARS:
                    size[lang] = 0
                    add(lang)
                    if len(sums[lang]) > 1_000_000:
                        yield out(lang)
    for lang in list(held):
        add(lang)
    for lang in list(sums):
        yield out(lang)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """tables[lang][order - 1]: (slots, counts, context slots, context totals, distinct followers, discount)."""

    def __init__(self, tables: dict[str, list[tuple]], bits: int):
        self.tables, self.langs, self.bits = tables, sorted(tables), bits
        self.limit: dict[str, float] = {}
        self.sharp = 4.0
        self.known, self.values = np.zeros(0, np.int64), np.zeros((0, len(self.langs)))

    def log_p(self, lang: str, codes: np.ndarray) -> np.ndarray:
        def find(keys: np.ndarray, values: np.ndarray, slots: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(keys, slots), len(keys) - 1)
            return np.where(keys[at] == slots, values[at], 0.0)

        u = codes.view(np.uint64)
        p = np.full(len(codes), 1 / 65536)
        for order, (keys, n, contexts, totals, kinds, d) in enumerate(self.tables[lang], 1):
            gram = u & np.uint64((1 << 16 * order) - 1)
            count = find(keys, n, _slots(gram, order, self.bits))
            context = _slots(gram >> np.uint64(16), 10 + order, self.bits)
            total, kind = find(contexts, totals, context), find(contexts, kinds, context)
            p = np.where(total > 0, (np.maximum(count - d, 0) + d * kind * p) / np.maximum(total, 1), p)
        return np.log(p)

    def table(self, codes: np.ndarray) -> np.ndarray:
        """log_p of distinct codes: a row for each, a column for each language. What was computed before is looked up."""
        at = np.minimum(np.searchsorted(self.known, codes), max(len(self.known) - 1, 0))
        hit = self.known[at] == codes if len(self.known) else np.zeros(len(codes), bool)
        out = np.empty((len(codes), len(self.langs)))
        out[hit] = self.values[at[hit]]
        new = codes[~hit]
        if len(new):
            out[~hit] = found = np.stack([self.log_p(x, new) for x in self.langs], axis=1)
            if (len(self.known) + len(new)) * len(self.langs) <= KNOWN:
                known = np.concatenate([self.known, new])
                order = np.argsort(known)
                self.known, self.values = known[order], np.concatenate([self.values, found])[order]
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy for each character, in nats: a row for each text (not empty), a column for each language."""
        g, _, n = _codes(texts)
        k, names = pd.factorize(g)
        begins, table = np.concatenate([[0], np.cumsum(n)[:-1]]), self.table(names)
        return np.stack([-np.add.reduceat(table[:, j][k], begins) / n for j in range(len(self.langs))], axis=1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, float | None]]:
        """(language, score, rejected, cross-entropy) for each text."""
        out: list = [("und", 0.0, True, None)] * len(texts)
        rows = [(i, t.lower()) for i, t in enumerate(texts) if t and has_letter(t)]
        if not self.langs:
            for i, _ in rows:
                out[i] = ("und", 0.0, False, None)
            return out
        loosest = max(self.limit.values(), default=np.inf)
        for held in _chunks(iter(rows), 1):
            x = self.entropies([t for _, t in held])
            best = x.argmin(axis=1)
            length = np.minimum([len(t) for _, t in held], 200)[:, None]
            score = 1 / np.exp(-self.sharp * np.sqrt(length) * (x - x.min(axis=1, keepdims=True))).sum(axis=1)
            for (i, t), b, s, e in zip(held, best, score, x, strict=True):
                lang = self.langs[b]
                slack = 1 + 4 / np.sqrt(len(t))  # short texts vary more
                out[i] = (lang, float(s), bool(e[b] > self.limit.get(lang, loosest) * slack), float(e[b]))
        return out


_SLOTTED = "lang string, level int, slot int, a long, b long"


def _slotted(bits: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level, code = batch.column("level").to_numpy(), batch.column("code").to_numpy()
            slot = np.zeros(len(code), np.int32)
            for k in np.unique(level):
                slot[level == k] = _slots(code[level == k], int(k), bits)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("level"), pa.array(slot), batch.column("a"), batch.column("b")], names=["lang", "level", "slot", "a", "b"])

    return apply


def _apart() -> Column:
    return F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(10)) == 0


def fit(docs: DataFrame, train: Column | None = None) -> Model:
    """A model of the documents that have lang and text and meet `train` (all of them by default: not held out)."""
    use = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (~held_out(F.col("doc_id")) if train is None else train))
    use = use.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    known = use.groupBy("lang").agg(F.bool_and(_apart()).alias("all_apart")).collect()
    # a language whose few documents would all be held apart is counted nevertheless
    counted = use.filter(~_apart() | F.col("lang").isin([r["lang"] for r in known if r["all_apart"]]))
    bits = max(8, min(SLOT_BITS, (SLOTS // max(len(known), 1)).bit_length() - 1))
    grams = {ORDER: cut(counted.select("lang", "text").mapInArrow(tidy(_count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))}
    for order in range(ORDER - 1, 0, -1):
        code = F.col("code").bitwiseAND(F.lit((1 << 16 * order) - 1))
        grams[order] = grams[order + 1].groupBy("lang", code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    every = None
    for order, d in grams.items():
        context = F.shiftrightunsigned("code", 16) if order > 1 else F.lit(0).cast("long")
        own = d.select("lang", F.lit(order).alias("level"), "code", F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))
        above = d.groupBy("lang", context.alias("code")).agg(F.sum("n").alias("a"), F.count(F.lit(1)).alias("b")).select("lang", F.lit(10 + order).alias("level"), "code", "a", "b")
        every = own.unionByName(above) if every is None else every.unionByName(own).unionByName(above)
    slots = every.mapInArrow(tidy(_slotted(bits)), _SLOTTED).groupBy("lang", "level", "slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    names = sorted(r["lang"] for r in known)
    number = F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int") if names else F.lit(0)
    packed = slots.select(number.alias("lang"), F.col("level").cast("byte").alias("level"), "slot", F.col("a").cast("float").alias("a"), F.col("b").cast("float").alias("b")).toArrow()
    lang, level, slot, n, m = (packed.column(c).to_numpy() for c in ("lang", "level", "slot", "a", "b"))
    order_ = np.lexsort((slot, level, lang))
    lang, level, slot, n, m = lang[order_], level[order_], slot[order_], n[order_], m[order_]
    tables: dict[str, list[tuple]] = {}
    for k in np.unique(lang):
        first, last = np.searchsorted(lang, [k, k + 1])

        def part(at: int, first=first, last=last) -> slice:
            a, b = first + np.searchsorted(level[first:last], [at, at + 1])
            return slice(a, b)

        tables[names[k - 1]] = rows = []
        for at in range(1, ORDER + 1):
            mine, above = part(at), part(10 + at)
            once, twice = int((n[mine] == 1).sum()), int((n[mine] == 2).sum())
            d = once / (once + 2 * twice) if once and twice else 0.5
            rows.append((slot[mine], n[mine], slot[above], n[above], m[above], min(max(d, 0.05), 0.95)))
    model = Model(tables, bits)
    _calibrate(model, use.filter(_apart() & F.col("lang").isin(model.langs)))
    return model


def _calibrate(model: Model, apart: DataFrame) -> None:
    if not model.langs:
        return
    shared = apart.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", _CHARS):
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True)
            for held in _chunks(((i, lang, t.lower()) for i, lang, t in rows if t and has_letter(t)), 2):
                x = shared.value.entropies([t for *_, t in held])
                n = np.array([len(t) for *_, t in held])
                own = x[np.arange(len(held)), [shared.value.langs.index(lang) for _, lang, _ in held]] / (1 + 4 / np.sqrt(n))
                gaps = np.sqrt(np.minimum(n, 200))[:, None] * (x - x.min(axis=1, keepdims=True))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, *_ in held], pa.int64()), "lang": pa.array([lang for _, lang, _ in held], pa.string()), "own": own, "gaps": pa.array(list(gaps), pa.list_(pa.float64()))})

    scored = cut(apart.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(tidy(apply), "doc_id long, lang string, own double, gaps array<double>"))
    model.limit = {lang: v * MARGIN for lang, v in scored.groupBy("lang").agg(F.percentile_approx("own", F.lit(1 - REJECT), F.lit(100_000))).collect()}
    rows = scored.orderBy(F.xxhash64("doc_id"), "doc_id", "own").limit(CALIBRATION).select("lang", "gaps").collect()
    if rows:
        g, r = np.array([x for _, x in rows]), np.array([model.langs.index(x) for x, _ in rows])
        loss = lambda s: -np.log(np.maximum((np.exp(-s * g) / np.exp(-s * g).sum(axis=1, keepdims=True))[np.arange(len(r)), r], 1e-12)).mean()
        model.sharp = min((0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0), key=loss)


def identify(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score, rejected and entropy, named after `prefix`, in place of columns of these names; every
    other column is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [prefix + x for x in ("lang_pred", "score", "rejected", "entropy")]
    docs = docs.drop(*added)
    names = [*docs.columns, *added]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", _CHARS):
            found = shared.value.predict(batch.column("text").to_pylist())
            lang, score, rejected, entropy = zip(*found, strict=True) if found else ((), (), (), ())
            more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(entropy, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)

    return docs.mapInArrow(tidy(apply), ", ".join([fields, *(f"{x} {t}" for x, t in zip(added, ("string", "double", "boolean", "double"), strict=True))]))


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each document, learned from those not held out."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
