"""Right results in the cases that ordinary data do not reach."""

import numpy as np
import pytest

from lodegraph.llm import neighbours as nb
from lodegraph.llm.grammar import problem


@pytest.mark.parametrize("block", [8192, 70])
def test_of_many_equal_vectors_the_smallest_ids_count(spark, block):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(700, 16))
    x[rnd.permutation(700)[:400]] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    copies = [i for i in range(700) if (x[i] == x[0]).all()]
    df = spark.createDataFrame([(f"v{i:03}", [float(a) for a in r], None, 1, 1.0) for i, r in enumerate(x)], "id string, embedding_vector array<float>, updated_at timestamp, leaf int, reach double")
    vectors = nb.cut(nb.usable_vectors(df, dim=16))
    found = nb.cut(nb.nearest(vectors, 10, radius=0.3, dim=16, block=block))
    got = {}
    for r in found.collect():
        got.setdefault(r.q, set()).add(r.x)
    for i in copies:
        assert got[f"v{i:03}"] == {f"v{j:03}" for j in copies if j != i and j in copies[:11]} - ({f"v{copies[10]:03}"} if i not in copies[:10] else set())
    first = [f"v{i:03}" for i in copies[:11]]
    pairs = {(r.a, r.b) for r in nb.mutual_pairs(found, 0.9).collect()}
    # the tenth and earlier have each other; the eleventh is in the lists of the ten before it and has them in its own
    assert {p for p in pairs if {*p} <= {f"v{i:03}" for i in copies}} == {(a, b) for a in first for b in first if a < b}


@pytest.mark.parametrize("n", [170, 3000])
def test_deep_nesting_is_no_error(n):
    chain = "if (a) { b(); } " + "else if (a) { b(); } " * n
    deep = "(" * n + "1" + ")" * n
    for language in ("javascript", "typescript"):
        assert problem(f"x = {deep};", language) is None and problem(f"x = {'[' * n}1{']' * n};", language) is None and problem(chain, language) is None
        assert problem(f"x = {deep});", language) is not None and problem(f"x = ({deep};", language) is not None
    java = "class A {{ int f(boolean a) {{ {} return 0; }} }}"
    assert problem(java.format(f"int x = {deep};"), "java") is None and problem(java.format(chain), "java") is None
    assert problem(java.format(f"int x = ({deep};"), "java") is not None
    go = "package p\n\nfunc f() {{\n{}\n}}\n"
    assert problem(go.format(f"x := {deep}"), "go") is None and problem(go.format(f"x := ({deep}"), "go") is not None
    assert problem(go.format("if a { b() } " + "else if a { b() } " * n), "go") is None


def test_maps_are_made_for_short_files_too(spark, monkeypatch):
    """What enters the maps: every Java and Go file, however short."""
    from lodegraph.llm import parsing

    rows = [("a", "FILE", "r", "A.java", "class A {}"), ("b", "FILE", "r", "b.go", "package b"), ("c", "FILE", "r", "c.js", "x"), ("d", "FILE", "r", "d.go", "package d\n" + "// x\n" * 5000)]
    df = spark.createDataFrame(rows, "id string, entity_type string, repository_id string, file_path string, content string").selectExpr("*", "timestamp'2024-01-01' as updated_at")

    def marked(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"entity_id": b.column(0), "unbalanced": pa.array(["mapped"] * len(b))})

    assert {r.stage for r in parsing.check_files(df).collect()} == {"statements", "whole"}
    monkeypatch.setattr(parsing, "_judge", marked)
    assert {r.file_path for r in parsing.check_files(df).where("problem = 'mapped' and stage = 'maps'").collect()} == {"A.java", "b.go", "d.go"}


def test_usual_texts_are_encoded_as_a_stream(monkeypatch):
    from lodegraph.llm import tokens

    vocab, early = tokens.vocabulary(tokens.DEFAULT_TOKENIZER), []
    feed = tokens.StreamEncoder.feed
    monkeypatch.setattr(tokens.StreamEncoder, "feed", lambda self, text: early.append(feed(self, text)) or early[-1])
    text = "for (int i = 0; i < count; i++) { total += value[i]; }\n" * 50
    assert tokens.encode(text, vocab).tolist() == vocab.fast.encode_ordinary(text)
    assert sum(map(len, early)) > 0
    assert tokens.encode("short", vocab).tolist() == vocab.fast.encode_ordinary("short")


def test_long_texts_take_little_memory():
    """Ten million characters, a part of them one endless pre-token, pass through in memory that does not grow with them."""
    import random
    import tracemalloc

    from lodegraph.llm import tokens

    vocab, rnd = tokens.vocabulary(tokens.DEFAULT_TOKENIZER), random.Random(4)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 9))) for _ in range(500)]
    parts = [" ".join(rnd.choices(words, k=2000)) for _ in range(20)]
    endless = "".join(rnd.choice("abcdefghijkl") for _ in range(20_000))
    tokens.encode(parts[0] + endless, vocab)
    tracemalloc.start()
    encoder, decoder, length, made = tokens.StreamEncoder(vocab), tokens.StreamDecoder(vocab), 0, 0
    while length < 10_000_000:
        part = endless if made == 50 else parts[made % 20]
        made, length = made + 1, length + len(part)
        back = decoder.feed(encoder.feed(part))
        assert len(back) <= 2 * len(part) + 4096
    decoder.feed(encoder.finish())
    decoder.finish()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000
