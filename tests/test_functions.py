"""Golden values of the column functions and operators, and their edge cases."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.tree import content
from quern.operators import order, packing, schedule
from quern.plans import learning, shards
from quern.plans.text import clean_table, extracted
from quern.plans.vectors import cosine, unit
from quern.sources import files, sinks


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"text {kind}").select(column(F.col("text")).alias("v")).first().v


@pytest.mark.parametrize(
    "text, patterns",
    [
        ("Hi <|endoftext|> and [USER] said |<user>| plus a <sep> tag.", {"pipe_angle", "bracket_upper", "pipe_wrapped_angle", "angle_bare"}),
        ("occupant[s] and http[s] and np.stack([s])", set()),
        ("<<SYS>>be helpful<</SYS>> [INST]hi[/INST] <|im_start|>user says </s>", {"double_angle_sys", "bracket_upper", "pipe_angle", "angle_bare"}),
        ("<h3>, <video>, [ERISA], [NASA] in prose", set()),
    ],
)
def test_ghosts(spark, text, patterns):
    assert set(one(spark, text, T.ghosts)) == patterns


def test_lines_and_blanks(spark):
    assert one(spark, "This is an exam-\nple of wrapped text, not a re-\nsult", lambda c: T.collapsed(T.joined_lines(c))) == "This is an example of wrapped text, not a result"
    assert one(spark, "a-\nb-\nc A-\nb", T.joined_lines) == "abc A-\nb"
    assert one(spark, "a  　b", T.collapsed) == "a b"
    assert one(spark, "\r\n x  \r\n\n\n\ty \n\n", T.tidy_code) == " x\n\n\ty"


def test_noise_and_scripts(spark):
    text = "﻿a​b\x0b��‌‍"
    row = clean_table(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (row.garbage_control_chars, row.zero_width_noise_chars, row.broken_utf_replacement_chars, row.zwnj_kept, row.zwj_kept) == (1, 2, 2, 1, 1)
    counts = lambda c: T.dominant(T.script_counts(c))
    assert one(spark, "Hello, world! This costs $42.50 (approx).", counts) == "latin"
    assert one(spark, "12345 - 67.89 % ()", counts) == ""
    assert one(spark, "12345", lambda c: T.purity(T.script_counts(c))) == 0.0


def test_clean_of_null_empty_and_long(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 200_000), (4, "Hello​ World﻿"), (5, "﻿Hello World")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in clean_table(rows).collect()}
    assert got[1].text == got[2].text == "" and got[1].script_purity == 0.0
    assert got[3].clean_len == 999_999
    assert got[4].sha1 == got[5].sha1
    assert clean_table(rows.limit(0)).count() == 0


@pytest.mark.parametrize("text, units", [("This is a new day", 5), ("India, officially the Republic of India", 7), ("भारत एक विशाल देश है।", 6), ("unbelievablexyzqwerty", 1), ("", 0)])
def test_faithful_units(spark, text, units):
    assert one(spark, text, T.faithful_units) == units


def test_extraction(spark):
    rows = spark.createDataFrame([("a", "see <video> and <h3>x</h3> in prose"), ("b", ""), ("c", None), ("d", "<html><body>x</body></html>"), ("e", "plain")], "id string, text string")
    assert {r.id: r.path for r in extracted(rows).collect()} == {"a": "inline_tags_stripped", "b": "empty", "c": "empty", "d": "html_fallback_stripped", "e": "passthrough"}
    route = spark.createDataFrame([("r", "/users/<chat_id>")], "id string, text string")
    assert extracted(route, "not-html").first().extracted == "/users/<chat_id>"
    page = "<html><nav>menu</nav><div class='cookie-box'>no</div><article><p>Body</p><table><td>1</td></table></article><p>after</p></html>"
    assert content(page) == "Body" and content(None) == ""


def test_usefulness(spark):
    rows = spark.createDataFrame([(-0.5,), (0.5,), (0.0,), (-1e-4,), (-1e-3,), (1e-3,), (None,)], "d double")
    assert [r.u for r in rows.select(learning.usefulness(F.col("d")).alias("u")).collect()] == ["useful", "harmful", "neutral", "neutral", "useful", "harmful", None]


def test_bins(spark):
    rows = spark.createDataFrame([("x", k, n) for k, n in enumerate([51, 50, 51, 50, 51, 50])], "g string, k int, n int")
    assert order.next_fit(rows, "g", "k", "n", 100).agg(F.max("bin")).first()[0] == 5
    assert order.best_fit(rows, "g", "k", "n", 100).agg(F.count_distinct("bin")).first()[0] == 5
    big = spark.createDataFrame([("x", 0, 30), ("x", 1, 500), ("x", 2, 30)], "g string, k int, n int")
    assert [r.bin for r in order.next_fit(big, "g", "k", "n", 100).orderBy("k").collect()] == [0, 1, 2]
    assert order.next_fit(big.limit(0), "g", "k", "n", 100).count() == 0


def compiled(spark, available, policy, floor=0.0, spans=((1.0, 1000),)):
    rows = [("r", f"s{i}", i, "a", w, floor, span, policy, available) for i, (w, span) in enumerate(spans)]
    lanes = spark.createDataFrame(rows, "run_id string, stage string, ord int, lane string, weight double, floor_weight double, span bigint, policy string, available bigint")
    return schedule.compile_lanes(lanes).orderBy("ord").collect()


def test_scarcity(spark):
    r = compiled(spark, 400, "repeat")[0]
    assert (r.effective_tokens, r.repeat_factor, r.status) == (1000.0, 2.5, "scarce_repeat")
    r = compiled(spark, 400, "reduce_share")[0]
    assert (r.effective_tokens, r.effective_weight, r.status) == (400.0, 0.4, "scarce_reduced")
    assert compiled(spark, 100, "reduce_share", 0.3)[0].effective_tokens == 300.0
    assert compiled(spark, 0, "reduce_share", 0.5)[0].status == "impossible"
    assert [x.effective_tokens for x in compiled(spark, 1000, "reduce_share", spans=((1.0, 700), (1.0, 500)))] == [700.0, 300.0]
    assert compiled(spark, 1000, "repeat", spans=((1.0, 700), (1.0, 500)))[1].repeat_factor == 1.2
    lanes = spark.createDataFrame([("r", "s", 0, "a", 1.0, 0.0, 10, "repeat", 0)], "run_id string, stage string, ord int, lane string, weight double, floor_weight double, span bigint, policy string, available bigint")
    with pytest.raises(schedule.ScarcityError):
        schedule.require_supply(schedule.compile_lanes(lanes))


def test_packing_golden(spark):
    wins = spark.createDataFrame([(0, 0, "x", 10, 0, 10)], "step int, slot int, lane string, sequence_length int, ws bigint, we bigint")
    docs = spark.createDataFrame([("x", "s", "docA", 0, 5, None, 0, 5), ("x", "s", "docB", 5, 11, 7, 5, 11)], "lane string, shard_id string, document_id string, start_token bigint, end_token bigint, response_start_token bigint, ds bigint, de bigint")
    row = packing.samples(packing.segments(wins, docs, 10)).first()
    assert row.segment_id == [0] * 5 + [1] * 5
    assert row.position_id == [0, 1, 2, 3, 4] * 2
    assert row.loss_mask == [1] * 5 + [0, 0] + [1, 1, 0]


def test_closed_form_packing_equals_a_walk(spark):
    import random

    rng = random.Random(4)
    lengths = [rng.randint(1, 40) for _ in range(30)]
    sizes = [rng.choice([16, 32]) for _ in range(40)]
    starts = [sum(lengths[:k]) for k in range(30)]
    docs = [("x", "s", f"d{k}", 0, n, None, starts[k], starts[k] + n) for k, n in enumerate(lengths)]
    ws = [sum(sizes[:k]) for k in range(40)]
    wins = [(k, 0, "x", n, ws[k], ws[k] + n) for k, n in enumerate(sizes) if ws[k] + n <= sum(lengths)]
    want, position = [], 0
    line = [(k, i) for k, n in enumerate(lengths) for i in range(n)]
    for step, _, _, n, low, _ in wins:
        held = line[low : low + n]
        for k in dict.fromkeys(d for d, _ in held):
            part = [i for d, i in held if d == k]
            want.append((step, f"d{k}", part[0], part[-1] + 1))
    w = spark.createDataFrame(wins, "step int, slot int, lane string, sequence_length int, ws bigint, we bigint")
    d = spark.createDataFrame(docs, "lane string, shard_id string, document_id string, start_token bigint, end_token bigint, response_start_token bigint, ds bigint, de bigint")
    got = [(r.step, r.document_id, r.s_start, r.s_end) for r in packing.segments(w, d, 32).collect()]
    assert sorted(got) == sorted(want) and position == 0


def test_append(spark):
    stored = spark.createDataFrame([("k1", "a"), ("k2", None)], "k string, c string")
    assert [r.k for r in shards.append(stored, spark.createDataFrame([("k1", "a"), ("k3", "b"), ("k3", "b"), ("k2", None)], "k string, c string"), ["k"], "c").collect()] == ["k3"]
    with pytest.raises(shards.ConflictError):
        shards.append(stored, spark.createDataFrame([("k1", "z")], "k string, c string"), ["k"], "c")


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [2.0, 0.0])], "a array<double>, z array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")).alias("ab"), cosine(F.col("a"), F.col("z")).alias("az"), unit(F.col("z")).alias("u")).first()
    assert (row.ab, row.az, row.u) == (1.0, 0.0, [0.0, 0.0])


def test_lineage_cycle(spark):
    edges = spark.createDataFrame([("r", "a", "b", 1), ("r", "b", "a", 1)], "run_id string, branch_id string, parent string, fork_step int")
    with pytest.raises(Exception, match="(?i)cycle|recursion"):
        learning.lineage(edges).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x"}\n\n{"id": "2", "text": null}\n')
    assert {(r.id, r.text) for r in files.load(spark, str(tmp_path / "a.jsonl")).collect()} == {("1", "x"), ("2", "")}
    (tmp_path / "b.json").write_text('{"data": [{"id": "1", "text": "x"}]}')
    assert files.load(spark, str(tmp_path / "b.json")).first().text == "x"
    (tmp_path / "c.txt").write_text("one\n\ntwo\n")
    assert {r.text for r in files.load(spark, str(tmp_path / "c.txt")).collect()} == {"one", "two"}
    assert files.load(spark, str(tmp_path / "c.txt"), text_mode="file").count() == 1
    (tmp_path / "d.csv").write_text("id,text\n1,x\n2,\n")
    assert {r.text for r in files.load(spark, str(tmp_path / "d.csv")).collect()} == {"x", ""}
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "e.xyz"))
    with pytest.raises(ValueError):
        files.documents(spark, "hub")


def test_freeze(tmp_path):
    path = str(tmp_path / "schedule.json")
    sinks.freeze({"a": 1}, path)
    assert sinks.thaw(path) == {"a": 1}
    (tmp_path / "schedule.json").write_text("{}")
    with pytest.raises(sinks.FrozenError):
        sinks.thaw(path)


# --- packing by best fit, against a list -------------------------------------------------------------------------------------


def best_fit_model(lengths, docs, seed, lane):
    """Windows filled one after another from a list of what waits: (document, from, to) of each segment."""
    import hashlib

    epoch, pending, carry, out = 0, [], None, []
    for length in lengths:
        at, window = 0, []
        while at < length:
            if carry is None:
                if not pending:
                    pending = sorted(docs, key=lambda d: hashlib.sha256(f"{seed}:lane_sequence:{lane}:{epoch}:s:{d[0]}".encode()).hexdigest())
                    epoch += 1
                fits = [d for d in pending if d[2] - d[1] <= length - at]
                carry = max(fits, key=lambda d: d[2] - d[1]) if fits else min(pending, key=lambda d: d[2] - d[1])
                pending.remove(carry)
            take = min(length - at, carry[2] - carry[1])
            window.append((carry[0], carry[1], carry[1] + take))
            at += take
            carry = (carry[0], carry[1] + take, carry[2]) if carry[1] + take < carry[2] else None
        out.append(window)
    return out


def packed_best(spark, lengths, docs, lane="code"):
    from quern.operators import packing

    wins = spark.createDataFrame([(k, 0, "st", lane, n) for k, n in enumerate(lengths)], "step bigint, slot int, stage string, lane string, sequence_length int")
    pool = spark.createDataFrame([(lane, "s", d, a, b, None) for d, a, b in docs] + [("other", "s", "z", 0, 5, None)], "lane string, shard_id string, document_id string, start_token bigint, end_token bigint, response_start_token bigint")
    rows = packing.best_fit_segments(wins, pool, "seed").orderBy("step", "w_start").collect()
    assert all(b.w_start == a.w_end for a, b in zip(rows, rows[1:]) if a.step == b.step)
    return [[(r.document_id, r.s_start, r.s_end) for r in rows if r.step == k] for k in range(len(lengths))]


def test_best_fit_takes_the_tightest_document(spark):
    docs = [("medium", 10, 16), ("small", 16, 20), ("exact", 0, 10)]
    first, second = packed_best(spark, [10, 10], docs)
    assert first == [("exact", 0, 10)] and second == [("medium", 10, 16), ("small", 16, 20)]
    # nothing fits: the shortest is cut, and its rest comes first in the next window
    assert packed_best(spark, [4, 4], [("a", 0, 9), ("b", 9, 15)]) == [[("b", 9, 13)], [("b", 13, 15), ("a", 0, 2)]]


def test_best_fit_equals_a_list(spark):
    import random

    rng = random.Random(5)
    for _ in range(3):
        docs, at = [], 0
        for k in range(rng.randint(1, 25)):
            n = rng.randint(1, 40)
            docs.append((f"d{k}", at, at + n))
            at += n
        lengths = [rng.choice((8, 16, 32)) for _ in range(40)]
        assert packed_best(spark, lengths, docs) == best_fit_model(lengths, docs, "seed", "code")


def test_replay_finds_an_altered_entry(spark):
    from oracle import DATA

    from quern.plans import packing as plans

    frozen = plans.schedule(spark, DATA)
    recorded = plans.stored_ledger(spark, DATA, frozen).filter("step < 3")
    altered = recorded.withColumn("loss_mask_hash", F.when((F.col("step") == 1) & (F.col("mb") == 0), "sha256:0").otherwise(F.col("loss_mask_hash")))
    again = plans.ledger(plans.sample_rows(spark, DATA, frozen=frozen, steps=(0, 3)))
    wrong = [(r.step, r.mb, r.spans_match) for r in plans.compared(altered, again).collect() if not r.loss_mask_hash_match]
    assert wrong == [(1, 0, True)]
    # entries that can't be recomputed match in nothing
    assert all(not r.spans_match for r in plans.compared(altered, again.filter("step > 2")).collect())


def test_checkpoints_and_forks(spark, tmp_path):
    from quern.operators.checkpoints import Checkpoints

    store = Checkpoints(spark, f"{tmp_path}/checkpoints")
    assert store.table().count() == 0
    rows = spark.createDataFrame([("r", "main", 3, "x"), ("r", "main", 3, "x"), ("r", "main", 9, "x")], "run_id string, branch_id string, global_step int, extra string")
    store.save(rows)
    store.save(rows)
    assert store.table().count() == 2
    store.fork(spark.createDataFrame([("r", "main", 3)], "run_id string, branch_id string, fork_step int"), "trial")
    assert store.restore("r", "trial", 3) == {"run_id": "r", "branch_id": "trial", "global_step": 3, "parent_branch_id": "main", "fork_step": 3}
    with pytest.raises(LookupError):
        store.restore("r", "main", 4)
    with pytest.raises(LookupError):
        store.fork(spark.createDataFrame([("r", "main", 4)], "run_id string, branch_id string, fork_step int"), "late")
    with pytest.raises(ValueError):
        store.fork(spark.createDataFrame([("r", "main", 3)], "run_id string, branch_id string, fork_step int"), "trial")


def test_row_indices_are_those_of_lines(spark, tmp_path):
    from quern.sources import files

    path = tmp_path / "d.jsonl"
    path.write_text('{"text": "a"}\n\n{"text": "b", "id": "x"}\n{"text": null}\n')
    assert [(r.id, r.text) for r in files.load(spark, str(path)).orderBy("text").collect()] == [("3", ""), ("0", "a"), ("x", "b")]
    lines = tmp_path / "d.txt"
    lines.write_text("\n".join(f"line {k}" if k % 3 else "" for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.load(spark, str(lines)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 2000 and all(r.text == f"line {r.id}" for r in rows)


def test_neighbours_in_blocks(spark):
    import random

    from quern.plans import vectors

    rng = random.Random(2)
    rows = [(k, [float(rng.randint(-2, 2)) for _ in range(3)]) for k in range(60)] + [(None, [1.0, 0.0, 0.0]), (99, None)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    queries = table.filter("vec_id % 10 = 0")
    whole = sorted(tuple(r) for r in vectors.neighbours(table, queries, 4).collect())
    assert whole == sorted(tuple(r) for r in vectors.neighbours(table, queries, 4, block=2).collect())
    for query in range(0, 60, 10):
        q = rows[query][1]
        norm = lambda v: sum(x * x for x in v) ** 0.5
        near = sorted((-round(sum(a * b for a, b in zip(q, v)) / (norm(q) * norm(v)) if norm(q) * norm(v) else 0.0, 6), k) for k, v in rows[:60] if k != query)[:4]
        assert [(k, -s) for s, k in near] == [(r[1], r[2]) for r in sorted((w for w in whole if w[0] == query), key=lambda w: w[3])]


def test_no_positive_weight_raises(spark):
    with pytest.raises(ValueError):
        schedule.positive(spark.createDataFrame([("a", 0.0)], "lane string, weight double"))
    with pytest.raises(ValueError):
        learning.ordered_by(spark.createDataFrame([("a",)], "k string"), "k", ["b"])


def test_axes_of_frames_are_aligned(spark):
    import numpy as np

    from quern.plans import extras

    rng = np.random.default_rng(4)
    data = {k: rng.normal(size=(40, 3)) * [5, 1, 0.2] @ np.linalg.qr(rng.normal(size=(3, 3)))[0] for k in range(6)}
    rows = [(k, x.tolist()) for k, own in data.items() for x in own] + [(None, [1.0, 2.0, 3.0]), (2, None)]
    table = spark.createDataFrame(rows, "label int, embedding array<double>").repartition(3)
    got = {r.label: np.array(r.v) for r in extras.aligned(extras.principal_axes(table)).collect()}
    assert sorted(got) == list(data)
    for k, own in data.items():
        axis = np.linalg.eigh(np.cov(own.T))[1][:, -1]
        assert abs(abs(axis @ got[k]) - 1) < 1e-9 and (k == 0 or got[k] @ got[k - 1] >= 0)
