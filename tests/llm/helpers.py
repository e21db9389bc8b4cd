"""Small inputs that hold every awkward case, and brute-force versions of what the operators compute."""

import random
import re

LONG = " ".join(f"w{i % 911}x{i % 37}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark, extra=True):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that clash with names used inside."""
    rows = [
        (1, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 63),
        (2, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 63),
        (2, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 63),
        (2, "another text under the same id", "en", None, None),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t ", "en", "a", 4),
        (None, "a text without an id", "en", "a", 20),
        (None, None, None, None, None),
        (6, LONG, "en", "b", len(LONG)),
        (7, LONG, "en", "b", len(LONG)),
        (8, "äöü ÄÖÜ ñ 漢字 \u0001 <|x|> 'tis don't", "de", "b", 30),
        (9, "spam " * 400, "en", "b", 2000),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("score", "chunk", "part", "fp", "h", "kind", "row", "id", "_id", "hits", "items", "kept", "spans", "label", "same", "n_words", "toxicity", "n_entities", "piece", "length"):
            df = df.withColumn(name, df.source)
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def random_docs(seed, n=60, vocab=40, size=120):
    """Documents that share passages of many lengths."""
    rng = random.Random(seed)
    passages = [" ".join(f"t{rng.randrange(vocab)}" for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    out = []
    for i in range(n):
        text = []
        while len(text) < rng.randrange(3, 9):
            text.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, size // 4))))
        out.append((i, " ".join(text)))
    return out


def brute_removed(units, width):
    """Which units a window that stands earlier covers; documents in order."""
    seen, out = set(), []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            key = u[i : i + width] if isinstance(u, bytes) else tuple(u[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            else:
                seen.add(key)
        out.append(gone)
    return out
