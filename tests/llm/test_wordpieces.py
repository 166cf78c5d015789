"""Piece counts against greedy matching that builds the pieces."""

from __future__ import annotations

import random

from awkward import outcome, words_of

from lyrebird.llm.wordpieces import PIECES, START, LongestMatch, has_bytes, load_pieces, op5_token_counts, token_counts


def greedy(word, pieces, longest):
    rest, n = START + word, 0
    while rest:
        k = next((k for k in range(min(longest, len(rest)), 0, -1) if rest[:k] in pieces), 0)
        if not k:
            return 0
        rest, n = rest[k:], n + 1
    return n


def test_random_vocabularies():
    rng = random.Random(2)
    for _ in range(200):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 12))}
        pieces |= {START + "".join(rng.choice("abc") for _ in range(rng.randrange(0, 4))) for _ in range(rng.randrange(1, 8))}
        match = LongestMatch(sorted(pieces))
        for _ in range(40):
            word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))
            assert match.count(word) == greedy(word, pieces, 6), (pieces, word)


def test_counts(docs, odd_docs, no_docs, rows):
    pieces = load_pieces(PIECES)
    known, longest = set(pieces), max(map(len, pieces))
    wanted = []
    for i, t, *_ in rows:
        n = [greedy(w.decode("utf-8", "replace"), known, longest) for w in words_of(t)]
        wanted.append((i, len(n), sum(max(1, x) for x in n), n.count(0)))
    assert outcome(token_counts(odd_docs, pieces)) == sorted(wanted, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert token_counts(no_docs, pieces).count() == 0


def byte_greedy(word, pieces, longest):
    """Greedy pieces of the whole list of a model; where none fits, the byte pieces of a letter."""
    rest, out = START + word, []
    while rest:
        k = next((k for k in range(min(longest, len(rest)), 0, -1) if rest[:k] in pieces), 0)
        out += [rest[:k]] if k else [f"<0x{b:02X}>" for b in rest[0].encode()]
        rest = rest[k or 1 :]
    assert pieces.issuperset(out)
    return out


def test_random_vocabularies_by_bytes():
    rng = random.Random(3)
    for _ in range(200):
        pieces = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 12))}
        pieces |= {START + "".join(rng.choice("abé") for _ in range(rng.randrange(0, 4))) for _ in range(rng.randrange(0, 8))}
        match = LongestMatch(sorted(pieces), by_bytes=True)
        everything = pieces | {f"<0x{b:02X}>" for b in range(256)}
        for _ in range(40):
            word = "".join(rng.choice("abé漢") for _ in range(rng.randrange(1, 14)))
            assert match.count(word) == len(byte_greedy(word, everything, 6)), (pieces, word)


def test_whole_model(spark, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    every = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    words = ["5", "2024", "ça", "ñandú", "ß", "漢字", "漢字漢字", "😀", "ok😀ok", "été", "of", "§12", "\U0001f9ff", "naïve‽"]
    longest = max(map(len, every))
    wanted = [len(byte_greedy(w, every, longest)) for w in words]
    assert START in load_pieces(PIECES) and has_bytes(PIECES)
    spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = outcome(op5_token_counts(spark, str(tmp_path)))
    assert sorted(got) == [(i, 1, n, 0) for i, n in enumerate(wanted)]
    plain = LongestMatch(load_pieces(PIECES))
    assert plain.count("5") == 2 and plain.count("漢") == 0  # without byte pieces only letters of no piece are unknown
