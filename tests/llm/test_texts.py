"""Operators on texts: round trips, brute force, and the dirt they must bear."""

import random
import re

import pytest

from lodegraph.llm import mixing, pieces, spans, tokens, winnow

DOCS = "doc_id long, text string, source string, owner string, h long, start int"


# tokens


def test_stream_equals_whole_text_and_decodes():
    v, rnd = tokens.vocabulary(), random.Random(2)
    for n in range(150):
        letters = rnd.choice(["ab", "aeiourstln", "  \n", " ", "=-", "日本語", "éabc", "'s x", "0123", "\x1c \x85a"])
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 2500))) + rnd.choice(["", " foo's", "  ", "'ll"])
        want = v.fast.encode_ordinary(text)
        for block in (16, 100, 700):
            assert list(tokens.encode(text, v, block)) == want, (n, block)
        d = tokens.StreamDecoder(v)
        assert "".join(d.feed([i]) for i in want) + d.finish() == text


def test_memory_of_an_endless_word_stays_constant():
    v = tokens.vocabulary()
    s = tokens.StreamEncoder(v, 256)
    out, most = [], 0
    for _ in range(40):
        out += s.feed("abcd" * 50)
        most = max(most, len(s.buf), len(s.piece.held) if s.piece else 0)
    assert most < 2000 and out + s.finish() == v.fast.encode_ordinary("abcd" * 50 * 40)


def test_ids_of_a_corpus(spark):
    rows = [(1, "Hello world", "a", "x", 1, 1), (2, "", "a", None, None, None), (3, None, None, None, None, None), (1, "Hello world", "a", "x", 1, 1), (None, "<|endoftext|>", None, None, None, None), (4, "long " * 40_000, "b", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, len(r.ids)) for r in tokens.encode_corpus(df, ["doc_id"]).collect()}
    v = tokens.vocabulary()
    assert got == {(1, 2), (2, 0), (3, 0), (None, len(v.fast.encode_ordinary("<|endoftext|>"))), (4, len(v.fast.encode_ordinary("long " * 40_000)))}
    assert tokens.encode_corpus(df, ["doc_id"]).count() == 6
    assert tokens.encode_corpus(df.where("false"), ["doc_id"]).count() == 0
    assert {(r.doc_id, r.n_tokens) for r in tokens.count_tokens(df, ["doc_id"]).collect()} == got


# mixing


def test_allotment():
    w = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 4), "none": (0.1, 3)}
    tok = {"a": 1000, "b": 100, "c": 50}
    free = mixing.allot(tok, w)
    shares = {s: free[s] * tok[s] for s in free}
    assert max(free[s] - w[s][1] for s in free) <= 1e-9
    assert abs(shares["a"] / shares["b"] - 5 / 3) < 1e-9 and abs(shares["b"] / shares["c"] - 1.5) < 1e-9
    full = mixing.allot(tok, w, total_tokens=1100)
    assert full["b"] == 2 and full["c"] == 4 and abs(full["a"] * 1000 - 700) < 1e-6
    assert mixing.allot({}, w) == {} and mixing.allot(tok, w, 10**9) == {"a": 1.0, "b": 2.0, "c": 4.0}


def test_mixture(spark):
    rnd = random.Random(4)
    sizes = {"big": 4000, "mid": 300, "small": 40}
    rows = [(n, " ".join(["word"] * rnd.randint(1, 60)), s, "o", 1, 1) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))]
    rows += [(-1, None, "big", None, None, None), (-2, "x", None, None, None, None), (-3, "x", "unweighted", None, None, None), (-4, "", "mid", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 3), ("small", 0.1, 5), ("absent", 0.2, 2), ("zero", None, None), (None, 0.1, 1)], "source string, target_weight double, max_repeats int")
    caps = {"big": 1, "mid": 3, "small": 5}
    for bucket in (50, 100_000):
        mix = mixing.mix_sources(docs, weights, bucket_rows=bucket)
        got = mix.collect()
        assert got and all(1 <= r.copies <= caps[r.source] for r in got)
        by = {}
        for r in got:
            by.setdefault(r.source, []).append(r.copies)
        assert all(max(c) - min(c) <= 1 for c in by.values())
        share = {r.source: r.share for r in mixing.mix_shares(mix, docs, weights).collect()}
        assert abs(share["big"] - 0.6) < 0.02 and abs(share["mid"] - 0.3) < 0.02 and abs(share["small"] - 0.1) < 0.02 and share["absent"] == 0
    a = {(r.doc_id, r.copies) for r in mixing.mix_sources(docs, weights).collect()}
    assert a == {(r.doc_id, r.copies) for r in mixing.mix_sources(docs.repartition(7), weights).collect()}
    assert mixing.mix_sources(docs.where("false"), weights).count() == 0 and mixing.mix_sources(docs, weights.where("false")).count() == 0


# shared spans


def shared_chars(docs: list[tuple[int, str]], n: int) -> dict[int, int]:
    where: dict[str, set[int]] = {}
    for i, x in docs:
        for k in range(len(x) - n + 1):
            where.setdefault(x[k : k + n], set()).add(i)
    out = {}
    for i, x in docs:
        covered = set()
        for k in range(len(x) - n + 1):
            if len(where[x[k : k + n]]) > 1:
                covered |= set(range(k, k + n))
        if covered:
            out[i] = len(covered)
    return out


@pytest.mark.parametrize("n,batches", [(200, 3), (37, 6)])
def test_shared_spans_like_brute_force(spark, n, batches):
    rnd = random.Random(n)
    word = lambda k: "".join(rnd.choice("abcdefgh \n日") for _ in range(k))
    span = [word(n + d) for d in (0, 0, 1, 60, -1, -1)]
    docs = [(i, word(rnd.randint(0, 4 * n))) for i in range(30)]
    for i, s in enumerate(span):
        for j in rnd.sample(range(30), 2 + (i == 3) * 8):
            k, x = docs[j]
            docs[j] = (k, x[: len(x) // 2] + s + x[len(x) // 2 :])
    twice = word(2 * n)
    docs += [(100, twice + "#" + twice), (101, word(3 * n)), (103, "x" * 3 * n), (104, "x" * (n - 1)), (105, "y" + "x" * (n - 1)), (106, None), (107, "")]
    docs.append((102, docs[31][1]))
    rows = [(i, x, "s", "o", 1, 1) for i, x in docs]
    rows.append(rows[31])  # a repeated row is the same document
    got = {r.doc_id: r.shared_chars for r in spans.shared_spans(spark.createDataFrame(rows, DOCS), n, batches).collect()}
    assert got == shared_chars([(i, x) for i, x in docs if x], n)


def test_index_is_kept_and_compacted(spark, tmp_path):
    post = lambda rows: spark.createDataFrame(rows, "h long, o1 long, o2 long")
    index = spans.FingerprintIndex(spark, 4, 2, str(tmp_path / "index"))
    assert index.add(post([(1, 7, 7), (2, 7, 7), (2, 7, 7)])).count() == 0
    index.close()
    index = spans.FingerprintIndex(spark, 4, 2, str(tmp_path / "index"))
    assert len(index.runs) == 1
    # 2 by a text that differs in the second half of its digest only, 3 within the batch
    assert sorted(r.h for r in index.add(post([(2, 7, 8), (1, 7, 7), (3, 1, 1), (3, 2, 1)])).collect()) == [2, 3]
    assert len(index.runs) == 1  # compacted
    index.close()
    index = spans.FingerprintIndex(spark, 4, 9, str(tmp_path / "index"))
    assert {(r.h, r.n) for r in index.add(post([(1, 9, 9), (4, 9, 9)])).collect()} == {(1, 3)} and len(index.runs) == 2
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")] and len(list((tmp_path / "index").iterdir())) == 2


def test_shared_spans_of_nothing(spark):
    assert spans.shared_spans(spark.createDataFrame([], DOCS)).count() == 0


def test_fingerprints_do_not_depend_on_what_is_around():
    import numpy as np

    rnd = random.Random(9)
    core = "".join(rnd.choice("abc ") for _ in range(900))
    for gram, window in ((101, 100), (10, 7)):
        p, h = winnow.fingerprints(winnow.code_points(core), gram, window)
        left = "".join(rnd.choice("xyz") for _ in range(333))
        q, g = winnow.fingerprints(winnow.code_points(left + core + left), gram, window)
        inside = (q >= 333) & (q + gram <= 333 + 900)
        assert set(p + 333) <= set(q[inside]) and np.diff(p).max() <= window
        old, winnow.SEGMENT = winnow.SEGMENT, 128
        try:
            p2, h2 = winnow.fingerprints(winnow.code_points(core), gram, window)
        finally:
            winnow.SEGMENT = old
        assert list(p) == list(p2) and list(h) == list(h2)


# pieces


ITEMS = "id string, entity_type string, content string, start_line int, updated_at timestamp, piece int, item string"


def check_pieces(text: str, rows: list, most: int, overlap: int) -> None:
    end = 0
    breaks = [m.end() for m in re.finditer("\r\n|\n|\r", text)]
    for n, r in enumerate(sorted(rows, key=lambda r: r.piece)):
        assert r.piece == n and r.content == text[r.start_char : r.end_char] and 0 < len(r.content) <= most
        assert r.start_char == (end - overlap if n else 0)
        assert r.start_line == 1 + sum(b <= r.start_char for b in breaks) and r.end_line == 1 + sum(b <= r.end_char - 1 for b in breaks)
        end = r.end_char
    assert end == len(text)


def test_pieces_of_entities(spark):
    rnd = random.Random(8)
    long = {f"e{i}": "".join(rnd.choice(["word ", "x", "\n", "\r\n", "\n\n", "é", "日本。", "😀", ". ", "\r"]) for _ in range(rnd.randint(800, 12_000))) for i in range(6)}
    long["blank"] = " " * 5000
    long["solid"] = "a" * 100_000
    rows = [(k, "FILE", x, None, None, 1, "z") for k, x in long.items()] + [("short", "FILE", "x" * 2048, 1, None, None, None), ("none", "FILE", None, None, None, None, None), (None, "FILE", "y" * 5000, None, None, None, None)]
    rows.append((" E0 ", "file", long["e0"], 7, None, None, None))
    df = spark.createDataFrame(rows, ITEMS)
    for size in (16 << 10, 3000):
        out: dict = {}
        for r in pieces.split_entities(df, range_bytes=size).collect():
            out.setdefault(r.item, []).append(r)
        assert sorted(out) == sorted(k for k, x in long.items() if len(x) > 2048)
        for k in out:
            check_pieces(long[k], out[k], 2048, 256)
    assert pieces.split_entities(df.where("false")).count() == 0


def test_pieces_end_at_natural_boundaries():
    steps = pieces.Steps(100, 10)
    text = "x" * 60 + "\n\nnext part " + "y" * 100
    (first, *_) = pieces.emit(steps, "i", 1, text.encode(), 0, len(text), 0, 0, len(text), True)
    assert first[6].endswith("\n\n")


def test_pieces_of_files(spark, tmp_path):
    text = "".join(random.Random(6).choice(["some words ", "\n", "é", "\r\n", "日本"]) for _ in range(30_000))
    path = tmp_path / "giant.txt"
    path.write_bytes(text.encode())
    (tmp_path / "small.txt").write_bytes(b"tiny")
    files = [(str(path), path.stat().st_size), (str(tmp_path / "small.txt"), 4)]
    a = pieces.split_files(spark, files, range_bytes=10_007).collect()
    assert {r.item for r in a} == {str(path)}
    check_pieces(text, a, 2048, 256)
