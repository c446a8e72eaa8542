"""Small document tables for the corpus operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and white texts, ties, repeated rows, other scripts.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one", None, "a", 3), (4, "one", None, "a", 3),
    (None, "no id here", "en", "b", 10), (5, "é日本語 \U0001f600 ünï", "de", "b", 12), (6, "1234 5678", None, None, 9),
]


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed: int, n: int, words: int = 60, langs=("en", "de"), lines: bool = True) -> list[tuple]:
    """n documents of invented words; some are copies, near copies, or share passages."""
    rng = random.Random(seed)
    vocab = {x: ["".join(rng.choice("aeiou" if k % 2 else s) for k in range(rng.randint(2, 8))) for _ in range(300)] for x, s in zip(langs, ("thnrsl", "zkfgwp"), strict=True)}
    passage = [rng.choice(vocab[langs[0]]) for _ in range(70)]
    out: list[tuple] = []
    for i in range(n):
        lang = langs[rng.random() < 0.4]
        w = [rng.choice(vocab[lang]) for _ in range(rng.randint(1, words))]
        if i % 7 == 3 and out:
            _, text, lang, *_ = out[rng.randrange(len(out))]
            w = text.split()
            if i % 2:
                w[rng.randrange(len(w))] = "changed"
        if i % 9 == 4 and lang == langs[0]:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        text = "".join(x + ("\n" if lines and k % 9 == 8 else " ") for k, x in enumerate(w)).rstrip()
        out.append((i, text, lang, f"s{rng.choice('0000123')}", len(text)))
    return out
