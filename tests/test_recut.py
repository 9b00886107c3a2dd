import random

import pytest

from lexilake.operators import chunking as H


@pytest.mark.parametrize("count", [H.size, H.words_and_marks, len])
def test_no_piece_is_above_the_limit(spark, count):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ab,;(-") for _ in range(rng.randrange(1, 9)))
    text = lambda n: "".join(word() + rng.choice([" ", " ", ". ", "\n\n", "; "]) for _ in range(n))
    rows = [(i, i % 3, 0, text(rng.choice([5, 50, 400])), i % 2 == 0) for i in range(30)] + [(90, 0, 1, "x" * 5_000, False), (91, None, 0, None, None), (92, 0, 0, "", False)]
    limits = H.Limits(least=5, target=30, most=40, count=count)
    chunks = spark.createDataFrame(rows, "doc_id long, section long, chunk int, text string, is_anchor boolean")
    got = H.recut(chunks, limits).collect()
    assert all(r.n_tokens == count(r.text) <= 40 for r in got)
    pieces = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        assert r.piece == len(pieces.setdefault(r.doc_id, []))
        pieces[r.doc_id].append(r.text)
    bare = lambda x: "".join(x.split()).replace(";", "")  # noqa: E731, a cut at a semicolon loses it
    assert {i: bare("".join(p)) for i, p in pieces.items()} == {i: bare(t or "") for i, _, _, t, _ in rows}
    assert H.recut(chunks.limit(0), limits).count() == 0


def test_chunks_by_another_counter():
    text = "52.1 Head\n\n" + "\n\n".join("one, two, three; four." for _ in range(200))
    words = H.section_chunks(text, "FAR")
    marks = H.section_chunks(text, "FAR", H.Limits(count=H.words_and_marks))
    assert len(marks) > len(words) and all(H.words_and_marks(x) <= 900 for x, _ in marks)
