"""Sharding, mixing and chat formatting: SQL, brute force, edge cases."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from oracle import SF, assert_same
from pyspark.sql import functions as F

from apexframe.llm import chat, mixing, queries, sharding

ODD = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, " \t\n", "a"), (3, "x " * 5000, "b"), (4, "é ü z", None)]


@pytest.mark.parametrize("name", ["op3_prefix_target_chat", "op7_waterfill_mix"])
def test_sql(spark, docs, name):
    docs([])
    assert_same(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


def draw(key, node):
    h = xxhash.xxh64(node.name.encode(), seed=xxhash.xxh64(key.encode(), seed=42).intdigest()).intdigest()
    return -np.log(((h >> 11) + 0.5) / (1 << 53)) / node.weight


def descend(key, node):
    while node.children:
        node = min(node.children, key=lambda c: draw(key, c))
    return node.shard


def test_tree_descent_is_the_drawn_one(spark):
    tree = sharding.build_tree(11, racks=2, shards=3, weights={0: 4.0, 7: 0.5})
    got = sharding.assign(spark.range(300).withColumnRenamed("id", "doc_id"), tree).collect()
    assert all(r["shard"] == descend(str(r["doc_id"]), tree) for r in got)
    share = Counter(r["shard"] for r in got)
    assert share[0] > share[7]


def test_growth_and_weights_move_rows_only_where_they_may(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = sharding.build_tree(40)
    out = sharding.assign(sharding.assign(rows, tree), sharding.grow(tree, 40), out="grown").collect()
    moved = [r for r in out if r["grown"] != r["shard"]]
    assert {r["grown"] for r in moved} == {40} and 40 < len(moved) < 160
    heavier = sharding.build_tree(40, weights={0: 3.0})  # region 0, rack 0
    out = sharding.assign(sharding.assign(rows, tree), heavier, out="grown").collect()
    assert all(r["grown"] < 20 for r in out if r["grown"] != r["shard"])  # nothing moves into the other region
    assert all(r["grown"] // 5 == 0 for r in out if r["shard"] < 20 and r["grown"] != r["shard"])


def test_shards_of_odd_rows(docs):
    df = docs(ODD).drop("shard")
    out = sharding.with_slots(sharding.assign(df, sharding.build_tree(3)), ["doc_id", "n_chars"]).collect()
    assert len(out) == len(ODD)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.with_slots(sharding.assign(docs([]), sharding.build_tree(3)), ["doc_id"]).count() == 0


def test_op1_query(spark, docs):
    docs([])
    out = queries.queries()["op1_hash_tree_shards"](spark, SF).toPandas()
    assert set(out["shard"]) <= set(range(40)) and (out.grown_shard.eq(out["shard"]) | out.grown_shard.eq(40)).all()
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])


def fill(sizes, cap=3, weights=(5, 2, 1)):
    """Water-filling as stated: clamp and reshare until none is above."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda x: (x is None, x or "")))}
    total, clamped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(clamped.values())
        targets = {s: w[s] * left / sum(w[x] for x in free) for s in free}
        over = [s for s in free if targets[s] > cap * sizes[s]]
        if not over:
            return targets | clamped
        clamped |= {s: cap * sizes[s] for s in over}


def test_targets_by_stated_rule(docs):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(n), s) for i, (n, s) in enumerate(zip(rng.integers(1, 60, 400), rng.choice(["a", "b", "c", "d", "e", "tiny"], 400, p=[0.4, 0.3, 0.1, 0.1, 0.095, 0.005]), strict=True))]
    rows += [(1000, "one two", None)]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    out = mixing.mix(docs(rows)).collect()
    want = fill(sizes)
    taken = defaultdict(int)
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["repetitions"] <= 3
        taken[r["source"]] += r["size"] * r["repetitions"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = {(r["doc_id"], r["repetitions"]) for r in mixing.mix(docs(rows[::-1])).collect()}
    assert again == {(r["doc_id"], r["repetitions"]) for r in out}
    assert mixing.repeat_rows(mixing.mix(docs(rows))).count() == sum(r["repetitions"] for r in out)


def test_mixing_odd_rows(docs):
    out = mixing.mix(docs(ODD)).collect()
    assert len(out) == len(ODD) and {r["size"] for r in out} == {0, 5000, 2}
    assert mixing.mix(docs([])).count() == 0
    assert [r["repetitions"] for r in mixing.mix(docs([(1, None, "a")])).collect()] == [0]


def test_escape_is_reversible(spark):
    texts = ["<|im_end|>", "<\\|", "<\\\\|x|>", "a<b|c", "<|<|", "\\", "$1 \\1", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"] and "<|" not in r["e"]


def test_every_assistant_turn_is_one_example(spark):
    rows = [(1, 0, "system", None), (1, 1, "user", "<|im_end|>"), (1, 2, "assistant", "é one"), (1, 3, "user", "more"), (1, 4, "assistant", "<|im_start|>two"), (1, 5, "user", "tail"),
            (2, 0, "user", "alone"), (3, 0, None, None), (None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash")).withColumn("upto", F.lit(1))
    ex = chat.format_examples(df).collect()
    per = Counter(r["conv_id"] for r in ex)
    assert per == {1: 3, 2: 1, 3: 1, None: 2}
    for r in ex:
        if r["loss_chars"]:
            assert r["text"].endswith(r["text"][r["loss_start"] :][: r["loss_chars"]] + "<|im_end|>\n")
    got = {r["conv_id"]: r for r in chat.digest_examples(chat.format_examples(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 6 and got[1]["loss_sha256"] == sha("é one<|im_start|>two") and got[1]["loss_chars"] == 20
    assert got[1]["turns_sha256"] == sha("system\n\nuser\n<|im_end|>\nassistant\né one\nuser\nmore\nassistant\n<|im_start|>two\nuser\ntail\n")
    assert got[2]["loss_chars"] == 0 and got[2]["loss_sha256"] == sha("") and got[3]["turns_sha256"] == sha("\n\n")
    assert got[None]["n_turns"] == 2 and got[None]["loss_chars"] == 2
    assert chat.digest_examples(chat.format_examples(df.limit(0))).count() == 0
