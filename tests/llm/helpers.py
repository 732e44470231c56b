"""Small tables with the awkward cases that every operator must take."""

import random

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(40_000))


def documents(spark, rows, extra=True):
    """(doc_id, text) rows as a table whose other columns have names that operators use inside."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    if not extra:
        return d
    return d.selectExpr("doc_id", "text", "'zz' AS lang", "cast(null AS string) AS source", "1L AS n_chars", "7L AS n", "'q' AS key", "1 AS rank", "2 AS pos", "3 AS component", "'c' AS copy", "4 AS n_removed", "5 AS score", "6 AS kept", "8 AS cluster")


def awkward():
    """Nulls, empties, blanks, long texts, ties and repeated rows."""
    return [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "one"), (6, "one two"), (7, "same text here again"), (7, "same text here again"), (8, "same text here again"), (None, "same text here again"), (9, LONG)]


def corpus(seed=1, n=60):
    """Random documents with exact copies, near copies and shared passages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = " ".join(word() for _ in range(70))
    base = [word() for _ in range(120)]
    out = []
    for i in range(n):
        k = r.random()
        if k < 0.15:
            text = " ".join(base)
        elif k < 0.5:
            text = " ".join(word() if r.random() < r.choice([0.01, 0.03, 0.1]) else w for w in base)
        else:
            words = [word() for _ in range(r.randint(5, 150))]
            if k > 0.8:
                at = r.randrange(len(words))
                words[at:at] = passage.split()[r.randrange(10) : 70 - r.randrange(10)]
            text = " ".join(words)
        out.append((i, text.replace(" ", "\n", 3) if r.random() < 0.3 else text))
    return out
