"""Operators that score or align single documents, against plain Python."""

import hashlib
import math
import re
import zlib

from helpers import ODD, docs, prose

#: The columns of each query's contract; more may follow.
CONTRACT = {
    "op1": "doc_id:bigint,n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string",
    "op2": "doc_id:bigint,size:bigint,source_size:bigint,target:double,taken:bigint",
    "op4": "doc_id:bigint,n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string",
    "op5": "doc_id:bigint,n_words:bigint,n_removed:bigint,kept_sha256:string",
    "op6": "doc_id:bigint,size:bigint,text_crc32:bigint,law:string,shard:int,slot:bigint,grown_shard:int",
    "op7": "doc_id:bigint,fingerprint:string,component_id:bigint",
    "op8": "doc_id:bigint,n_chars:bigint,edited_sha256:string,fingerprint:string,edited_fingerprint:string,near_edited:double,near_next:double",
    "op9": "doc_id:bigint,held_out:boolean,lang_pred:string,score:double",
    "op10": "doc_id:bigint,n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,contaminated:boolean",
    "op11": "doc_id:bigint,n_features:bigint,weight:bigint,score:bigint,rank:bigint",
    "op12": "doc_id:bigint,held_out:boolean,score:double,predicted:int",
    "op13": "doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,n_best:bigint,count_sum:bigint,groups_sha256:string",
}


def test_schemas_keep_their_contracts(spark, sf_dir):
    from paceline.llm.queries import QUERIES

    for name, query in QUERIES.items():
        want = CONTRACT.get(name.split("_")[0])
        if want:
            kinds = dict(query(spark, sf_dir).dtypes)
            assert {c: kinds.get(c) for c, _ in (x.split(":") for x in want.split(","))} == dict(x.split(":") for x in want.split(",")), name


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def resampled(rows, target):
    source, want = [(r[0], *features(r[1])) for r in rows], [b for t in target for b in features(t)[1]]
    s, t = [0] * 10_000, [0] * 10_000
    for b in (b for *_, hashed in source for b in hashed):
        s[b] += 1
    for b in want:
        t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000) / ((s[b] + 1) * (sum(t) + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, hashed in source:
        weight = sum(gain[b] for b in hashed) // len(hashed) if hashed else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(hashed), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    may = sorted((x for x in out if x[-1] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    drawn = may[: len(may) * 25 // 100]
    return [(*x[:4], None) for x in out if x not in drawn] + [(*x[:4], k + 1) for k, x in enumerate(drawn)]


def test_resampling_matches_plain_python(spark):
    from paceline.llm import resample

    rows = [*ODD, *prose(3, 150), (900, "Ünï x " * 30_000, "de", "a", 1), (None, "a lone text of words " * 5, None, None, 1)]
    target = [None, "", "Some of Thnr's words", " ".join(r[1] for r in rows[20:25])]
    bench = spark.createDataFrame([(k, t, k) for k, t in enumerate(target)], "item_id long, text string, rank int")
    d = docs(spark, rows).selectExpr("*", "1 AS n_words", "2 AS hashed", "3 AS rank", "4 AS score")
    key = lambda x: tuple((v is None, v or 0) for v in x)
    for per_range in (20_000, 25):
        got = resample.resample(d.repartition(4), bench, per_range=per_range).select("doc_id", "n_features", "weight", "score", "rank")
        assert sorted(map(tuple, got.collect()), key=key) == sorted(resampled(rows, target), key=key)
    assert resample.resample_report(docs(spark, []), bench).count() == 0
    empty = resample.resample_report(docs(spark, rows[:30]), bench.limit(0)).collect()
    assert len(empty) == 30 and sum(r["rank"] is not None for r in empty) == sum(features(r[1])[0] >= 20 for r in rows[:30]) * 25 // 100


class Tokenizers:
    """Both tokenizers by other libraries than the operator's, over whole texts."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        from paceline.llm import tokenalign

        self.a = Tokenizer.from_file(f"{tokenalign.VOCABULARIES}/{tokenalign.A_FILE}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{tokenalign.VOCABULARIES}/{tokenalign.B_FILE}")
        self.letters = tokenalign.byte_of_letter()

    def of(self, text):
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        spell = lambda p: bytes.fromhex(p[3:5]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
        return [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in a], [(i, spell(self.b.id_to_piece(i))) for i in b]


def ranges(tokens):
    at, out = 0, []
    for i, piece in tokens:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def aligned(rows):
    from collections import Counter

    tokenizers, parts = Tokenizers(), []
    for i, text, *_ in rows:
        a, b = tokenizers.of(text) if text else ([], [])
        whole = text and b"".join(x for _, x in a) == b"".join(x for _, x in b) == b" " + text.encode()
        parts.append((i, ranges(a) if whole else [], ranges(b) if whole else []))
    linked = [[(x, y) for x, p, q in a for y, r, s in b if p < s and r < q] for _, a, b in parts]
    count = Counter(pair for links in linked for pair in set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (i, a, b), links in zip(parts, linked, strict=True):
        ends, groups, begin = sorted({q for *_, q in a} & {q for *_, q in b}), [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x) for x, _, q in side if begin < q <= end) for side in (a, b)))
            begin = end
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), sha))
    return out


def test_alignment_matches_plain_python(spark):
    from paceline.llm import tokenalign

    odd = ["  two  spaces   ", " ", "a ", "tab\t and\n\nlines \n x", "▁ mark", "it's 1234 <|endoftext|> <s>", "ﬁ ½ é  nbsp", "日本語 \U0001f600\U0001f468‍\U0001f469 x", "x" * 300, "Der eingeä erer. " * 40]
    rows = [*ODD, *((1000 + k, t, None, None, 0) for k, t in enumerate(odd)), *prose(5, 60)]
    d = docs(spark, rows).selectExpr("*", "1 AS a", "2 AS b", "3 AS common", "4 AS lone", "5 AS row")
    key = lambda x: tuple((v is None, v or 0) for v in x[:1]) + tuple(map(str, x[1:]))
    want = sorted(aligned(rows), key=key)
    for often in (100_000, 50, 1):
        assert sorted(map(tuple, tokenalign.align(d.repartition(3), often=often).collect()), key=key) == want
    assert tokenalign.align(docs(spark, [])).count() == 0


def test_alignment_of_a_long_text(spark):
    from paceline.llm import tokenalign

    text = " ".join(r[1] for r in prose(6, 2_000))
    got = tokenalign.align(docs(spark, [(1, text, None, None, 0)])).first()
    a, b = Tokenizers().of(text)
    assert (got.n_a, got.n_b, got.n_links) == (len(a), len(b), len(a) + len(b) - got.n_groups)


def test_words_are_tokenised_as_within_their_texts():
    import random

    from paceline.llm import tokenalign as T

    whole, rng = Tokenizers(), random.Random(3)
    pair = T.Pair(*(open(f"{T.VOCABULARIES}/{f}", "rb").read() for f in (T.A_FILE, T.B_FILE)))
    signs = ["a", "b'", "s", "'ll", " ", "  ", "\n", "\t", "1", "é", ".", "!", "日", " the", "$"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(2_000)]
    got = [(iter(ids.tolist()), n.tolist()) for ids, n in pair.encode(texts)]
    for k, text in enumerate(texts):
        sides = whole.of(text) if text else ([], [])
        same = b"".join(x for _, x in sides[0]) == b"".join(x for _, x in sides[1]) == b" " + text.encode()
        for (ids, n), side in zip(got, sides, strict=True):
            assert [next(ids) for _ in range(n[k])] == ([i for i, _ in side] if same else [])


def test_portions_are_aligned_as_plain_python_aligns_texts():
    """Groups and links of words put together are those of whole texts, without Spark's part."""
    import random

    from paceline.llm import tokenalign as T

    whole, rng = Tokenizers(), random.Random(4)
    pair = T.Pair(*(open(f"{T.VOCABULARIES}/{f}", "rb").read() for f in (T.A_FILE, T.B_FILE)))
    signs = ["a", "b'", "s", "ing", "tokenis", " ", "  ", "\n", "é", ".", "1", "日本", " the", "ﬁ", "x" * 40]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    (n_a, n_b, n_groups), shas, links, n = pair.align(texts)
    want, at = aligned([(k, t) for k, t in enumerate(texts)]), 0
    assert [x[1:5] + x[7:] for x in want] == list(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n.tolist(), shas, strict=True))
    assert any(x[1] == 0 for x in want) and any(x[4] > x[3] for x in want)
    for t, k in zip(texts, n.tolist(), strict=True):
        some, at = links[at : at + k], at + k
        if k:
            a, b = map(ranges, whole.of(t))
            assert some.tolist() == [(x << 32) + y for x, p, q in a for y, r, u in b if p < u and r < q]
    assert at == len(links) and [len(x) for x in pair.align([])[1:]] == [0, 0, 0]


def test_alignment_interprets_no_array_function_for_each_token(spark, monkeypatch):
    """Array functions with lambdas over a document's tokens took most of the CPU; tasks give documents aligned."""
    from paceline.llm import tokenalign

    stored, cut = [], tokenalign.cut
    monkeypatch.setattr(tokenalign, "cut", lambda d: stored.append(d) or cut(d))
    assert tokenalign.align(docs(spark, prose(7, 3))).count() == 3
    plan = stored[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not re.search("Generate|lambda|array_intersect|transform", plan)


def test_steps_follow_the_non_negative_risk():
    """The slope of a step is that of the risk, by differences, where the clean part is positive."""
    import numpy as np

    from paceline.llm import toxicity as X

    vocabulary = {w: i for i, w in enumerate("abcdef")}
    pos, unl, prior = X.Bags(["a b b", "a c", None], vocabulary), X.Bags(["d e", "a f f", "c", "b d zz"], vocabulary), 0.3
    w = np.array([0.5, -0.2, 0.1, 0.4, -0.6, 0.3, -1.0])

    def parts(w):
        g, u = pos.margins(w[:-1], w[-1]), unl.margins(w[:-1], w[-1])
        return prior * X.softplus(-g).mean(), X.softplus(u).mean() - prior * X.softplus(g).mean(), g, u

    _, clean, g, u = parts(w)
    assert clean > 0
    slope = pos.gradient(-prior * X.sigmoid(-g) / pos.n, 6) + unl.gradient(X.sigmoid(u) / unl.n, 6) - pos.gradient(prior * X.sigmoid(g) / pos.n, 6)
    for k in range(7):
        d = np.eye(7)[k] * 1e-6
        assert abs((sum(parts(w + d)[:2]) - sum(parts(w - d)[:2])) / 2e-6 - slope[k]) < 1e-6


def test_toxicity_learns_rare_families_of_words():
    import random

    import numpy as np

    from paceline.llm import toxicity as X

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(1_500)]
    family = ["zuqa" + "".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(20)]

    def text(kind):
        out = rng.choices(words, k=120)
        return " ".join(out + (rng.choices(["vilest", "rotten"], k=4) if kind == 1 else rng.sample(family, 3) if kind == 2 else []))

    # a tenth is toxic, and one in ten of these by a word of the family alone
    toxic = lambda: 2 if rng.random() < 0.1 else 1
    some = lambda: toxic() if rng.random() < 0.1 else 0
    weights, bias = X.train([text(toxic()) for _ in range(600)], [text(some()) for _ in range(3_000)], 0.1)

    def margin(t):
        names, x = X.counts_of(t)
        return sum(weights.get(w, 0.0) * v for w, v in zip(names, x, strict=True)) + bias

    rare, clean = [margin(text(2)) for _ in range(100)], [margin(text(0)) for _ in range(300)]
    assert sum(m > max(clean) for m in rare) >= 95 and sum(X.sigmoid(np.array(rare)) >= X.THRESHOLD) >= 90
    assert all(weights.values())


def test_toxicity_finds_what_it_never_saw(spark):
    import random

    from paceline.llm import toxicity as X

    rng, rows, labels = random.Random(4), [], []
    insults = ["vilest", "rotten", "dimwit", "filthy"]
    for i, text, *rest in prose(8, 1_500, words=50):
        toxic = i % 6 == 0
        words = text.split() or ["x"]
        for _ in range(max(2, len(words) // 20) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(insults).upper() if rng.random() < 0.2 else rng.choice(insults))
        rows.append((i, " ".join(words), *rest))
        if rng.random() < 0.5:
            labels.append((i, rng.choice([0, 1]), int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (99_999, 1, 1)]
    odd = [(i if i is None else i + 50_000, *more) for i, *more in ODD]
    d = docs(spark, rows + odd).selectExpr("*", "1 AS toxic", "2 AS score", "3 AS h", "'x' AS model").repartition(5)
    held = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = X.toxicity_report(d, held).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    tested = [r for r in got if r.held_out and r.doc_id < 50_000]
    caught = [r.predicted for r in tested if r.doc_id % 6 == 0]
    wrong = [r.predicted for r in tested if r.doc_id % 6]
    assert sum(caught) >= 0.9 * len(caught) > 30 and sum(wrong) <= 0.01 * len(wrong)
    again = {(r.doc_id, r.score) for r in X.toxicity_report(d.repartition(2), held.repartition(3)).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    assert {r.score for r in X.toxicity_report(d, held.filter("toxic = 0")).collect()} == {0.0}
    assert X.toxicity_report(docs(spark, []), held).count() == 0
