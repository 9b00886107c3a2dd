"""Ids that repeat with other texts, and a session without a named shared folder."""

import os
import subprocess
import sys

from lexilake.llm import minhash


def _text(seed, n=200):
    return " ".join(f"w{(seed * 7919 + i * i * 31) % 5003}x{i}" for i in range(n))


def test_a_repeated_id_joins_what_its_texts_are_linked_with(spark):
    a, b, c = _text(1), _text(2), _text(3)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, a), (5, b), (6, c), (7, ""), (7, c + " z"), (8, None), (8, _text(4)), (None, a), (9, _text(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    want = {
        (1, 196, 1, True), (2, 197, 1, False), (3, 197, 1, False), (4, 196, 1, False), (5, 196, 1, False), (6, 196, 6, True), (7, 0, 6, False), (7, 197, 6, False),
        (8, 0, 8, True), (8, 196, 8, True), (None, 196, None, True), (9, 196, 9, True),
    }
    assert got == want
    assert {r.doc_id for r in minhash.keep_one_of_each(docs).collect()} == {1, 6, 8, 9, None}


def test_ids_at_the_end_of_their_range(spark):
    high = 2**63 - 1
    a, b = _text(1), _text(2)
    docs = spark.createDataFrame([(high, a), (high, b), (5, a + " x"), (6, b + " y")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()} == {(high, 5), (5, 5), (6, 5)}


def test_without_a_named_folder_one_is_made(tmp_path):
    code = (
        "from lexilake.session import local_session\nfrom lexilake.llm import tokens\nfrom lexilake.llm.common import shared_dir\n"
        "s = local_session(2, 2)\nassert s.conf.get('spark.checkpoint.dir', None) is None\n"
        "d = s.createDataFrame([(1, 'a b'), (2, None)], 'doc_id long, text string')\n"
        "assert tokens.token_output(d).count() == 2 and shared_dir(s) == shared_dir(s)\n"
    )
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
