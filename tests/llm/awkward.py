"""Small tables with everything that is awkward in them."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: extra columns whose names the operators use themselves
CLASHES = ["size", "n", "node", "component", "key", "phrase", "a", "b", "shard", "slot", "score", "target", "starts", "counts", "part", "cell", "first", "_score"]


def corpus(seed: int = 1, groups: int = 12) -> list[tuple]:
    """Unrelated texts, near and exact copies, shared passages, short, empty, null and long texts, repeated rows and ids."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, line = text(70), text(12)
    rows, k = [], 0

    def add(words, source="s1", sep=" ", doc_id=None):
        nonlocal k
        k += 1
        body = words if isinstance(words, str) or words is None else sep.join(words)
        rows.append((k if doc_id is None else doc_id, body, "en", source, len(body or "")))

    for g in range(groups):
        base = text(rng.choice([6, 30, 120, 400]))
        add(base, f"s{g % 5}")
        for _ in range(rng.randrange(5)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            add(copy, "s1", rng.choice([" ", "\n", "  "]))
        add([w.upper() for w in base], None)
        add(text(40) + passage + text(rng.randrange(30)), "s2")
        add(line + text(8) + line, "s3")
    for body in ("", None, " \t\n", "one", "one two three four", "one two three four", "x" * 500, "a\x0bb\x0cc\x1cd", "ünï cödé 漢字 😀", "no break and　space", "<p>a&amp;b</p>"):
        add(body, "s4")
    add(passage * 2, "s1")
    add(text(3000), "s1")
    add(passage[:49], "s1")
    add(passage[:50], "s1")
    rows += [rows[0], rows[0], rows[3]]  # repeated rows
    rows.append((rows[5][0], " ".join(text(90)), "en", "s1", 1))  # an id with another text
    rows += [(None, rows[0][1], "en", "s1", 1), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def outcome(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
