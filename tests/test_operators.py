"""Unit cases of the operators: multiset differences, statistics, clones, cycles, paging, stages, reviews."""

from __future__ import annotations

import bisect
import json
import math
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.functions import dims
from waymark.functions import normalize as N
from waymark.functions.stats import wilcoxon_p
from waymark.operators import crm, diff, ingest
from waymark.operators import metrics as M
from waymark.operators import stages as T
from waymark.sources import artifacts as S


def counts_of(spark, rows):
    return spark.createDataFrame(rows, "evaluation_id string, scope_id string, rule_id string, file string, message string")


def test_multiset_difference_respects_copies(spark):
    case = {"pre": ["same", "dup", "dup"], "post": ["same", "dup", "new"], "base": ["old", "same"]}
    found = counts_of(spark, [(e, "backend", r, None, "") for e, rs in case.items() for r in rs])
    pairs = spark.createDataFrame([("run_local", "post", "pre"), ("trajectory_cumulative", "post", "base"), ("run_local", "base", "base")], "delta_scope string, evaluation_id string, pre string")
    out = {(r.delta_scope, r.evaluation_id): r for r in diff.multiset_counts(diff.finding_counts(found), pairs).collect()}
    local, total, own = out["run_local", "post"], out["trajectory_cumulative", "post"], out["run_local", "base"]
    assert (local.introduced_count, local.resolved_count, local.unchanged_count, local.net_change) == (1, 1, 2, 0)
    assert (total.introduced_count, total.resolved_count) == (2, 1)
    assert (own.introduced_count, own.resolved_count, own.net_change) == (0, 0, 0)
    items = {(r.delta_scope, r.rule_id, r.change_type, r.n) for r in diff.surplus(diff.finding_counts(found), pairs).collect()}
    assert items == {("run_local", "new", "introduced", 1), ("run_local", "dup", "resolved", 1), ("trajectory_cumulative", "dup", "introduced", 1), ("trajectory_cumulative", "new", "introduced", 1), ("trajectory_cumulative", "old", "resolved", 1)}


def test_score_diff_without_source_is_unavailable(spark):
    post = spark.createDataFrame([("m", 1.0), ("n", None)], "k string, value double")
    pre = spark.createDataFrame([("n", 2.0)], "k string, value double")
    assert {r.k: (r.delta, r.delta_status) for r in diff.score_diff(post, pre, ["k"]).collect()} == {"m": (None, "unavailable"), "n": (None, "unavailable")}


def test_pair_join_deals_no_exchange_by_the_baseline(spark):
    """Half of the pairs look back to one checkpoint: broadcast or salted, results stay, and no exchange is keyed by `pre` alone but for the few others."""
    gen = random.Random(3)
    cp = spark.createDataFrame([("baseline/Base", "baseline", 0)] + [(f"S{s}/T{t}", f"S{s}", t) for s in range(40) for t in range(1, 5)], "evaluation_id string, session_id string, task_order int")
    found = counts_of(spark, [(r.evaluation_id, gen.choice("ab"), gen.choice(["r1", "r2", None]), gen.choice(["f", None]), "") for r in cp.collect() for _ in range(gen.randint(0, 6))])
    counts, pairs = diff.finding_counts(found), diff.make_pairs(cp)
    held = {}
    for r in found.collect():
        held.setdefault(r.evaluation_id, []).append(tuple(r)[1:])
    want = set()
    for r in pairs.collect():
        a, b = Counter(held.get(r.evaluation_id, [])), Counter(held.get(r.pre, []))
        want |= {(r.delta_scope, r.evaluation_id, *k, kind, n) for kind, d in (("introduced", a - b), ("resolved", b - a)) for k, n in d.items()}
    assert {tuple(r) for r in diff.surplus(counts, pairs).collect()} == want
    for most in (0, 1000):
        joined = diff.PairJoin(pairs, broadcast_rows=most)
        assert joined.hot.select("pre").first().pre == "baseline/Base"
        out = joined.join(joined.pairs, counts.select(F.col("evaluation_id").alias("pre"), *diff.IDENTITY, "n"), [], "left")
        assert sorted(map(repr, ((r.evaluation_id, r.pre, r.n) for r in out.where("n is not null").collect()))) == sorted(map(repr, ((p.evaluation_id, p.pre, n) for p in pairs.collect() for n in Counter(held.get(p.pre, [])).values())))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = diff.surplus(counts, pairs)._jdf.queryExecution().executedPlan().toString()
        assert diff.PairJoin(pairs).pairs.where("pre = 'baseline/Base' and __salts is null").isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # what the baseline holds is broadcast; only the filtered rest is dealt by `pre`
    assert plan.count("BroadcastExchange") >= 2 and all("isnull" in x for x in [plan] if "hashpartitioning(pre" in x)


def test_resolve_pre_rejects_ambiguous_commits(spark):
    cp = spark.createDataFrame([("b", "baseline", "c0"), ("s/1", "s", "c1"), ("s/2", "s", "c1"), ("s/3", "s", "c3")], "evaluation_id string, session_id string, commit_id string")
    wanted = spark.createDataFrame([("x", "s", "c0"), ("y", "s", "c1"), ("z", "s", "c3"), ("w", "s", "none")], "evaluation_id string, session_id string, pre_commit string")
    resolved, rejected = diff.resolve_pre(cp, wanted)
    assert dict(map(tuple, resolved.collect())) == {"x": "b", "z": "s/3"}
    assert dict(map(tuple, rejected.collect())) == {"y": "ambiguous", "w": "no_checkpoint"}


def test_wilcoxon_of_the_published_pairs(spark):
    diffs = {"claude": [-2, -1, 2], "codex": [-1, -8, -2]}
    pairs = spark.createDataFrame([(a, f"T{i}", 10.0, 10.0 + d) for a, ds in diffs.items() for i, d in enumerate(ds)], "agent string, task_id string, minimal double, structured double")
    got = {r.agent: (r.statistic, round(r.p_value, 5), r.median_diff) for r in T.paired_wilcoxon(pairs).collect()}
    assert got == {"claude": (2.5, 1.0, -1.0), "codex": (0.0, 0.25, -2.0), None: (4.0, 0.21875, -1.5)}
    assert wilcoxon_p(0.0, [], 0, 0.0) == 1.0
    assert T.paired_wilcoxon(pairs.limit(1)).where("agent is null").first().note == "fewer than 2 complete pairs"


def test_running_counts_and_quantiles_of_a_hot_group(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), float(rng.randrange(400))) for _ in range(3000)] + [("one", 7.0)]
    counts = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count("*").alias("m"))
    placed = T.running_counts(counts.repartition(8), "g", "v")
    groups = {g: sorted(v for h, v in rows if h == g) for g, _ in rows}
    for r in placed.collect():
        assert (r.below, r.total) == (bisect.bisect_left(groups[r.g], r.v), len(groups[r.g]))
    for r in T.quantiles(placed, "g", "v", [0.25, 0.5, 1.0]).collect():
        assert r.q == pytest.approx(np.quantile(groups.pop(r.g), [0.25, 0.5, 1.0]).tolist())
    assert not groups


@pytest.mark.parametrize(("values", "shape"), [([1, 2], "insufficient_data"), ([3, 3, 3], "flat"), ([1, 2, 3, 4], "linear"), ([1, 2, 5, 9], "accelerating"), ([1, 5, 6, 6], "plateau_or_decline")])
def test_trajectory_shapes(spark, values, shape):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "session_id string, task_order int, cumulative_introduced long")
    assert T.trajectory_shape(df, ["session_id"]).first().shape == shape


def test_gini_and_top_file(spark):
    rows = [("r", "a", 1), ("r", "b", 3), ("r", "c", 3)]
    got = T.file_concentration(spark.createDataFrame(rows, "evaluation_id string, file string, n long")).first()
    assert (got.files, got.findings, got.top_file, got.gini) == (3, 7, "b", round((4 - 2 * (1 + 4 + 7) / 7) / 3, 6))


def test_pca_of_a_line_has_one_component(spark):
    obs = spark.createDataFrame([(f"e{i}", m, float(i * k)) for i in range(6) for m, k in (("a", 1), ("b", -2))], "evaluation_id string, metric_name string, value double")
    spectrum, loadings, scores = T.metric_pca(obs, ["a", "b"])
    assert [round(r.explained_share, 9) for r in spectrum.orderBy("component").collect()] == [1.0, 0.0]
    assert scores.count() == 6 and loadings.count() == 4
    assert T.metric_pca(obs.where("evaluation_id < 'e3'"), ["a", "b"]) is None


def brute_clones(files: dict[int, list[tuple[str, int]]], w: int, cap: int) -> tuple[int, int]:
    places: dict[tuple, list] = {}
    for f, toks in files.items():
        for i in range(len(toks) - w + 1):
            places.setdefault(tuple(t for t, _ in toks[i : i + w]), []).append((f, i))
    covered = set()
    for spots in places.values():
        if not 2 <= len(spots) <= cap:
            continue
        for x in range(len(spots)):
            for y in range(x + 1, len(spots)):
                (f, i), (g, j) = spots[x], spots[y]
                if f == g and abs(i - j) < w:
                    continue
                n = w
                while i + n < len(files[f]) and j + n < len(files[g]) and files[f][i + n][0] == files[g][j + n][0]:
                    n += 1
                covered |= {(f, line) for _, line in files[f][i : i + n]} | {(g, line) for _, line in files[g][j : j + n]}
    return len({(f, line) for f, ts in files.items() for _, line in ts}), len(covered)


@pytest.mark.parametrize("seed", range(3))
def test_clone_lines_equal_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(M, "LARGEST_BUCKET", 4)
    shared = [rng.choice("abc") for _ in range(30)]
    texts = []
    for _ in range(12):
        words = [rng.choice("abcdef") for _ in range(rng.randint(0, 20))]
        at = rng.randint(0, len(words))
        words[at:at] = shared[rng.randint(0, 8) : rng.randint(15, 30)]
        texts.append("".join(w + rng.choice([" ", " ", "\n"]) for w in words))
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "project string, file long, text string").select("project", "file", M.normalised_tokens(F.col("text")).alias("tokens"))
    files = {r.file: [(t.tok, t.line) for t in r.tokens] for r in df.collect()}
    got = M.clone_lines(df, 6).first()
    assert (got.lines, got.cloned_lines) == brute_clones(files, 6, 4)


def test_clone_windows_by_class(spark):
    body = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = {"exact": [body, body], "different": [body, body[::-1]], "short": ["a b c", "a b c"], "self": [body + "\n" + body]}
    df = spark.createDataFrame([(p, i, t) for p, ts in rows.items() for i, t in enumerate(ts)], "project string, file long, text string").select("project", "file", M.normalised_tokens(F.col("text")).alias("tokens"))
    got = {r.project: r.clone_ratio for r in M.clone_lines(df).collect()}
    assert got == {"exact": 1.0, "different": 0.0, "short": 0.0, "self": 1.0}


def test_windows_of_texts_that_are_nowhere_else_are_not_shuffled(spark):
    texts = [" ".join(f"f{chr(97 + f // 26)}{chr(97 + f % 26)}{chr(97 + i // 26 // 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(2000)) for f in range(40)]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "project string, file long, text string").select("project", "file", M.normalised_tokens(F.col("text")).alias("tokens"))

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    assert M.clone_lines(df).first().cloned_lines == 0
    assert written() - before < 8 * 40 * 1951  # a rank for every window


@pytest.mark.parametrize("texts", [["x " * 14], ["x " * 40], ["x " * 60], ["x y " * 30 + "z"], ["x " * 11, "x " * 8], ["x " * 50, "x " * 50 + "y " * 50, "y " * 6]])
def test_clones_of_texts_that_repeat_one_word(spark, texts):
    df = spark.createDataFrame([("p", i, t.replace(" ", "\n")) for i, t in enumerate(texts)], "project string, file long, text string").select("project", "file", M.normalised_tokens(F.col("text")).alias("tokens"))
    files = {r.file: [(t.tok, t.line) for t in r.tokens] for r in df.collect()}
    for window in (6, 7, 8):
        got = M.clone_lines(df, window).first()
        assert (got.lines, got.cloned_lines) == brute_clones(files, window, M.LARGEST_BUCKET)


def test_a_bridge_between_cycles_is_not_cyclic(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("x", "y"), ("z", "z"), ("q", None)]
    df = spark.createDataFrame([("p", a, b) for a, b in edges], "project string, src string, dst string")
    got = {(r.src, r.dst) for r in M.cyclic_edges(df).collect()}
    assert got == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("z", "z")}
    assert M.dependency_density(df, dims.forbidden_layers(spark)).first().density == round(5 / 7, 6)


def brute_cycles(edges: list[tuple[str, str, str]]) -> set[tuple[str, str, str]]:
    after = {}
    for p, a, b in edges:
        after.setdefault((p, a), set()).add(b)

    def reach(p, a):
        seen, stack = set(), [a]
        while stack:
            for b in after.get((p, stack.pop()), ()):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        return seen

    return {(p, a, b) for p, a, b in edges if a in reach(p, b) or a == b}


@pytest.mark.parametrize("small", [0, 30, 1000])
def test_cyclic_edges_equal_brute_force(spark, small):
    gen = random.Random(small)
    edges = set()
    for p in "uvwx":
        n = gen.choice([6, 15, 40])
        edges |= {(p, f"n{gen.randrange(n)}", f"n{gen.randrange(n)}") for _ in range(gen.choice([5, n, int(1.2 * n)]))}
    edges |= {("ring", f"k{i}", f"k{(i + 1) % 9}") for i in range(9)} | {("ring", "in", "k0"), ("ring", "k3", "x1"), ("ring", "x1", "x2"), ("ring", "x2", "x3"), ("ring", "x3", "k1")}
    df = spark.createDataFrame([*edges, ("u", "n0", None)], "project string, src string, dst string")
    assert {tuple(r) for r in M.cyclic_edges(df, small).collect()} == brute_cycles(sorted(edges))


def test_a_long_way_takes_few_rounds(spark, monkeypatch):
    """A path of 10,000 nodes beside a cycle, and a ring as long, in rounds of doubled reach."""
    rounds = []
    settle = M.settled
    monkeypatch.setattr(M, "settled", lambda df: rounds.append(1) or settle(df))
    path = spark.range(9_999).select(F.lit("p").alias("project"), F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    cycle = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "5", "a")], path.schema)
    assert {(r.src, r.dst) for r in M.cyclic_edges(path.unionByName(cycle), 0).collect()} == {("a", "b"), ("b", "c"), ("c", "a")}
    assert len(rounds) < 40
    assert M.cyclic_edges(path.unionByName(spark.createDataFrame([("p", "9999", "0")], path.schema)), 0).count() == 10_000


def test_occurrences_equal_contains(spark):
    gen = random.Random(6)
    texts = [(p, i, "".join(gen.choices("ab1", k=n))) for i, (p, n) in enumerate([(gen.choice("pq"), gen.choice([0, 1, 2, 5, 600, 1500])) for _ in range(20)])]
    words = {(gen.choice("pq"), "".join(gen.choices("ab1", k=gen.choice([0, 1, 2, 3, 7, 9, 12])))) for _ in range(60)} | {("p", texts[5][2][:700])}
    got = M.occurrences(spark.createDataFrame(texts, "project string, id long, text string"), spark.createDataFrame([*words, ("p", None)], "project string, word string"))
    assert {tuple(r) for r in got.collect()} == {(i, w) for p, i, t in texts for q, w in words if p == q and w in t}


def test_a_migration_of_a_megabyte(spark):
    text = " ".join(f"ALTER T{i % 9} ADD COL_{i}_X;" for i in range(48_000))
    assert len(text) > 1_000_000
    migrations = spark.createDataFrame([("p", text, text.replace("ADD", "DROP"), True), ("p", "ADD T1 LATE", "DROP T1", True), ("p", "T1 LOST", "T1 LOST", False)], "project string, up string, down string, executable boolean")
    names = [("t1", f"col_{i}_x") for i in range(0, 96_000, 1000)] + [("t99", "col_1_x"), ("t1", "late"), ("t1", "lost"), ("t1", ""), (None, "a")]
    changes = spark.createDataFrame([("p", t, c, "added") for t, c in names], "project string, table_name string, column_name string, change string")
    began = time.time()
    left = {(r.table_name, r.column_name) for r in M.uncovered_changes(changes, migrations).collect()}
    assert left == {("t1", f"col_{i}_x") for i in range(48_000, 96_000, 1000)} | {("t99", "col_1_x"), ("t1", "late"), ("t1", "lost"), (None, "a")}
    assert time.time() - began < 60


def test_empty_denominators(spark):
    calls = spark.createDataFrame([("p", None)], "project string, path string")
    assert M.endpoint_misses(calls, calls).first().miss_ratio is None
    row = spark.createDataFrame([("p", 0, 0)], "project string, covered int, total int")
    assert M.coverage(row).first().coverage == 1.0
    assert M.per_case(row.toDF("project", "mocks", "cases")).first().per_case is None


def test_page_bounds():
    assert [crm.page_bounds(*a) for a in ((), (2, 50), (0, 0), ("x", "y"), (1, 1000), (None, "7"))] == [(1, 10), (2, 50), (1, 10), (1, 10), (1, 100), (1, 7)]


def test_legacy_stages(spark):
    cases = {"Lead": "lead", "QUALIFIED": "qualified", "active": "active", "Negotiation": "negotiation", "closed_WON": "closed_won", "closed_lost": "closed_lost", "won": "closed_won", "Lost": "closed_lost", "prospect": "lead", "proposal_sent": "negotiation", "": "lead", "  ": "lead", "mystery": "lead"}
    df = spark.createDataFrame(list(cases.items()), "a string, b string").withColumn("c", crm.canonical_stage(F.col("a")))
    assert all(r.b == r.c for r in df.collect())
    assert spark.range(1).select(crm.canonical_stage(F.lit(None).cast("string")).alias("c")).first().c == "lead"


def test_replay_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(crm, "REPLAY_RANGE", 7)
    rng = random.Random(1)
    rows = [(d, s, rng.choice([*dims.STAGES, "odd"]), rng.randint(0, 2), rng.random() < 0.5) for d in range(5) for s in range(60)]
    got = {r.deal_id: (r.moves, r.rejected, r.stage) for r in crm.replay_stages(spark.createDataFrame(rows, "deal_id long, seq long, to_stage string, n_contacts long, has_close_date boolean")).collect()}
    for d in range(5):
        stage, rejected = "lead", 0
        for _, _, to, n, dated in sorted(r for r in rows if r[0] == d):
            if to != stage:
                ok = (stage, to) in dims.STAGE_MOVES and (to != "active" or n) and (to != "negotiation" or dated)
                stage, rejected = (to, rejected) if ok else (stage, rejected + 1)
        assert got[d] == (60, rejected, stage)


def test_link_migration_is_idempotent(spark):
    contacts = spark.createDataFrame([(1, 10), (2, None), (3, 11)], "id long, company_id long")
    none = spark.createDataFrame([], "contact_id long, company_id long, is_primary boolean")
    once = crm.migrate_links(contacts, none)
    assert {tuple(r) for r in once.collect()} == {(1, 10, True), (3, 11, True)}
    assert crm.migrate_links(contacts, once).count() == 0


def test_since_after_until_is_an_error(spark):
    with pytest.raises(ValueError, match="after"):
        crm.interaction_feed(spark.range(1), since="2024-02-01", until="2024-01-01")


def test_versions_order_by_number(spark):
    runs = spark.createDataFrame([(1, None, "z", "p0"), (1, "v2", "a", "p1"), (1, "v2.10", "b", "p2"), (1, "v2.9", "c", "p3")], "k int, adapter_version string, completed_at string, path string").withColumn("run_id", F.lit(None).cast("string"))
    assert ingest.select_acceptance_run(runs, ["k"]).first().path == "p2"


def test_failure_text_and_files(spark):
    row = spark.createDataFrame([("expected 200 OK got 404", "CHECKPOINT 12 fails", "`a/b.ts:1:2`, `c.ts`")], "t string, i string, l string")
    got = row.select(N.failure_class(F.col("t")).alias("c"), N.checkpoint_number(F.col("i")).alias("n"), N.referenced_files(F.col("l")).alias("f")).first()
    assert (got.c, got.n, got.f) == ("route_variance", "12", ["a/b.ts", "c.ts"])


def test_readers_tolerate_broken_and_missing_files(spark, tmp_path):
    for task, text in (("T1", json.dumps({"run_id": "r", "scopes": [{"scope_id": "backend", "layers": {"metrics": [{"name": "m", "score": {"value": 2}}]}}]})), ("T2", "{broken")):
        (tmp_path / "s1" / task).mkdir(parents=True)
        (tmp_path / "s1" / task / "harness_evaluation.json").write_text(text)
    rows, rejects = S.read_evaluations(spark, str(tmp_path))
    got = rows.collect()
    assert [(r.evaluation_id, r.task_order) for r in got] == [("s1/T1", 1)] and rejects.count() == 1
    assert rows.select(N.metric_value(F.col("scopes")[0]["layers"]["metrics"][0]["score"]).alias("v")).first().v == 2.0
    assert S.read_executions(spark, str(tmp_path))[0].count() == 0


def test_session_config(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "session_manifest.yaml").write_text("session_id: s1\ncreated_at: '2026-08-17'\ninitial_config:\n  agent: codex\n  strategy: minimal\n")
    assert tuple(S.read_session_config(spark, str(tmp_path)).first()) == ("s1", "codex", "minimal", None, "2026-08-17")


def test_reviews(spark):
    texts = ["- severity: high\n- location: `a.ts:1`\n- **issue**: x\n- severity: low\n", "| severity | location | issue | impact | recommended_improvement |\n|-|-|-|-|-|\n| high | a | b | c | d |\n", f"{S.NO_ISSUES}\n- severity: high", "nothing", None]
    rows = S.parse_reviews(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    got = {r.id: (r.review_status, [f.asDict() for f in r.findings]) for r in rows.collect()}
    assert [got[i][0] for i in range(5)] == ["issues_found", "issues_found", "no_issues_found", "parse_incomplete", "parse_incomplete"]
    assert got[0][1] == [{"severity": "high", "location": "a.ts:1", "issue": "x", "impact": "", "recommended_improvement": ""}, {"severity": "low", "location": "", "issue": "", "impact": "", "recommended_improvement": ""}]
    assert got[1][1] == [dict(zip(S.REVIEW_FIELDS, "high a b c d".split(), strict=True))]


def test_run_all_stops_at_the_first_failure():
    seen = []
    with pytest.raises(RuntimeError, match="b failed after a"):
        S.run_all([("a", lambda: seen.append(1)), ("b", lambda: 1 / 0), ("c", lambda: seen.append(3))])
    assert seen == [1]


def test_refresh_runs_what_must_and_goes_on_after_a_failure(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    put = lambda name, n: spark.range(n).write.mode("overwrite").parquet(at(name))
    ran, broken = [], []

    def copy(source, target):
        def run():
            if target in broken:
                raise ValueError("no")
            ran.append(target)
            spark.read.parquet(at(source)).write.mode("overwrite").parquet(at(target))

        return run

    job = lambda source, target, **more: S.Job(target, [at(source)], [at(target)], copy(source, target), **more)
    jobs = [job("b", "c"), job("a", "b"), job("x", "y")]
    put("a", 3), put("x", 2)
    assert [j.name for j in S.in_order(jobs)] == ["b", "y", "c"]
    assert S.refresh(spark, jobs, at("manifest")) == ["b", "y", "c"] == ran
    assert S.refresh(spark, jobs, at("manifest")) == []
    put("x", 5)
    assert S.refresh(spark, jobs, at("manifest")) == ["y"] and spark.read.parquet(at("y")).count() == 5
    assert S.refresh(spark, [job("b", "c", version="2"), *jobs[1:]], at("manifest")) == ["c"]
    put("a", 9)
    broken.append("c")
    with pytest.raises(RuntimeError, match="c failed after b"):
        S.refresh(spark, jobs, at("manifest"))
    broken.clear()
    assert S.refresh(spark, jobs, at("manifest")) == ["c"] and spark.read.parquet(at("c")).count() == 9
    with pytest.raises(RuntimeError, match="lacks"):
        S.refresh(spark, [job("nothing", "z")], at("other"))
    for bad in ([job("p", "q"), job("q", "p")], [job("a", "q"), S.Job("again", [], [at("q")], print)]):
        with pytest.raises(ValueError):
            S.in_order(bad)


def test_pages_by_the_directory(spark):
    gen = random.Random(1)
    rows = spark.createDataFrame([(i, gen.choice([None, *range(40)])) for i in range(1005)], "id long, v int")
    order = crm.deal_order("value")
    pages = crm.PageDirectory(rows.withColumnRenamed("v", "value"), order, ranges=16)
    whole = [tuple(r) for r in rows.withColumnRenamed("v", "value").orderBy(*order).collect()]
    for page in (1, 2, 5, 10, 11, 12, "x"):
        n = page if isinstance(page, int) else 1
        assert [tuple(r) for r in pages.page(page, 100).collect()] == whole[(n - 1) * 100 : n * 100]
    assert pages.meta(3, 100) == {"page": 3, "limit": 100, "total": 1005, "total_pages": 11}
    scans = pages.page(9, 100)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scans and "__range" in scans.split("PartitionFilters: [")[1].split("]")[0]
    none = crm.PageDirectory(rows.limit(0), [F.asc("id")])
    assert none.page().count() == 0 and none.meta()["total_pages"] == 0


def test_stage_replay_of_composed_ranges(spark):
    gen = random.Random(4)
    rows = [(d, s, gen.choice([*dims.STAGES, "odd", None]), gen.choice([0, 1, None]), gen.choice([True, False, None])) for d in (1, 2, 3) for s in gen.sample(range(-50, 5000), 300)]
    df = spark.createDataFrame(rows, "deal_id long, seq long, to_stage string, n_contacts int, has_close_date boolean")
    want = {}
    for d in (1, 2, 3):
        stage, rejected = dims.STAGES[0], 0
        for _, _, to, n, dated in sorted((r for r in rows if r[0] == d), key=lambda r: r[1]):
            met = (to != "active" or (n or 0) >= 1) and (to != "negotiation" or bool(dated))
            if met and (stage, to) in dims.STAGE_MOVES:
                stage = to
            elif to != stage:
                rejected += 1
        want[d] = (300, rejected, stage)
    for width in (10, 100_000):
        assert {r.deal_id: (r.moves, r.rejected, r.stage) for r in crm.replay_stages(df, width).collect()} == want
    assert crm.replay_stages(df.limit(0)).count() == 0


def test_exact_and_normal_p_equal_the_plain_ones(spark):
    gen = random.Random(7)
    cases = [(0.0, [], 0, 0.0)]
    for n in (1, 3, 12, 40):
        ranks = [float(r) for r in range(1, n + 1)]
        if n > 3:
            ranks[1] = ranks[2] = 2.5
        cases.append((float(min(w := sum(r for r in ranks if gen.random() < 0.4), sum(ranks) - w)), ranks, n, 6.0 if n > 3 else 0.0))
    cases += [(float(s), None, 80, 24.0) for s in (0, 300, 900, 1500, 1620)]
    df = spark.createDataFrame(cases, "s double, ranks array<double>, n long, t double")
    got = [r.p for r in df.select(T.signed_rank_p(F.col("s"), F.col("ranks"), F.col("n"), F.col("t")).alias("p")).collect()]
    assert got == pytest.approx([wilcoxon_p(*c) for c in cases], rel=1e-9, abs=1e-15)
    x = [0.0, 0.1, 1.0, 2.9, 3.0, 3.1, 5.0, 9.0]
    told = [r.e for r in spark.createDataFrame([(v,) for v in x], "x double").select(T.complementary_error(F.col("x")).alias("e")).collect()]
    assert told == pytest.approx([math.erfc(v) for v in x], rel=1e-9)


def test_correlations_of_500_metrics(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(5, 2, (120, 500))
    x[:, 7] = 3.0  # one value
    x[:, 9] = 2 * x[:, 8] + 1
    has = draw.random(x.shape) < 0.7
    rows = [(f"e{i}", f"m{j:03}", float(x[i, j]) if has[i, j] else None) for i in range(120) for j in range(500)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["evaluation_id", "metric_name", "value"]))
    got = {(r.metric_a, r.metric_b): r.r for r in T.metric_correlation(df).collect()}
    assert len(got) == 499 * 500 // 2 and got["m008", "m009"] == 1.0 and ("m007", "m008") not in got
    for a, b in [(0, 1), (3, 499), (8, 200), (250, 251)]:
        both = has[:, a] & has[:, b]
        assert got[f"m{a:03}", f"m{b:03}"] == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=2e-6)


def test_settled_tables_can_be_released(spark):
    from waymark.functions.checkpoints import release, settled

    release(spark)
    df = settled(spark.range(5))
    assert df.count() == 5 and release(spark) == 1 and release(spark) == 0
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_session_comparison_equals_pairs_and_deals_findings_out_once(spark):
    gen = random.Random(11)
    chain = [(f"S{s}/T{t}", f"S{s}", f"T{t}", t, "a", "minimal") for s in range(6) for t in (1, 2, 4, 5)] + [("baseline/Base", "baseline", "Base", 0, "none", "none")]
    cp = diff.chained(spark.createDataFrame(chain, "evaluation_id string, session_id string, task_id string, task_order int, agent string, strategy string"))
    rows = [(e, "backend", f"r{gen.randrange(3)}", gen.choice(["f", None]), "m") for e, *_ in chain for _ in range(gen.choice([0, 2, 7]) if e != "baseline/Base" else 6)]
    counts = diff.finding_counts(counts_of(spark, rows)).cache()
    base = counts.where("evaluation_id = 'baseline/Base'").groupBy(*diff.IDENTITY).agg(F.sum("n").alias("n"))
    beside = diff.along_sessions(counts.join(cp, "evaluation_id"), base)
    pairs = diff.make_pairs(cp)
    want = {tuple(r) for r in diff.multiset_counts(counts, pairs).select("delta_scope", "evaluation_id", "before_count", "after_count", "introduced_count", "resolved_count", "unchanged_count").collect()}
    wide = diff.session_counts(cp, beside, base)
    got = {(scope, r.evaluation_id, *[r[f"{c}_before"], r.after_count, r[f"{c}_introduced"], r[f"{c}_resolved"], r[f"{c}_unchanged"]]) for r in wide.collect() for scope, c in (("run_local", "local"), ("trajectory_cumulative", "base"))}
    assert got == want and len(got) == 2 * len(chain)
    columns = ["delta_scope", "evaluation_id", *diff.IDENTITY, "change_type", "n"]
    want = Counter(tuple(r) for r in diff.surplus(counts, pairs).select(*columns).collect())
    assert Counter(tuple(r) for r in diff.session_surplus(cp, beside, base).select(*columns).collect()) == want
    for scope in ("run_local", "trajectory_cumulative"):
        assert Counter(tuple(r) for r in diff.introduced(beside, scope).select(*columns).collect()) == Counter({k: n for k, n in want.items() if k[0] == scope and k[-2] == "introduced"})
    plan = diff.introduced(beside, "run_local")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "delta_scope" in plan


def test_documents_are_read_once_by_every_builder(spark):
    doc = "evaluation_id string, session_id string, task_id string, task_order int, agent string, strategy string, " + S.EVALUATION.replace("task_id string, ", "").replace("`from`", "`from`")
    f = lambda rule, scope=None: {"rule_id": rule, "scope": scope, "location": {"file": "f.ts"}, "message": None}
    metric = lambda name, scope, delta: {"name": name, "scope": scope, "delta": delta}
    made = {"evaluation_id": "S/T1", "session_id": "S", "scopes": [
        {"scope_id": "backend", "layers": {"constraints": {"findings": [f("BE-A-C-1")]}, "metrics": [{"name": "m", "status": "pass", "score": "1"}, {"name": "k", "status": "pass", "score": "2"}]}}, {"scope_id": "frontend", "layers": None}],
        "deltas": {"run_local": {"constraints": {"introduced": [f("BE-A-C-1", "backend")] * 2, "resolved": None}, "metrics": [metric("m", "backend", 1.0), metric("m", "backend", 2.0), metric("m", None, 3.0)]}}}
    docs = spark.createDataFrame([made, {"evaluation_id": "S/T2", "session_id": "S"}], doc)
    found = ingest.build_constraint_findings(docs)
    assert sorted((r.evaluation_id, r.scope_id, r.file, r.message, r.delta_scope, r.change_type) for r in found.collect()) == [("S/T1", "backend", "backend/f.ts", "", "absolute", "current")] + [("S/T1", "backend", "backend/f.ts", "", "run_local", "introduced")] * 2
    seen = ingest.build_metric_observations(docs)
    assert sorted((r.metric_name, r.value, r.delta_run_local, r.delta_trajectory_cumulative) for r in seen.collect()) == [("k", 2.0, None, None), ("m", 1.0, 2.0, None)]
    for df in (found, seen, ingest.build_runs(docs)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_texts_are_listed_and_read_in_tasks(spark, tmp_path):
    for name, text in {"a/S 1/T1/x.json": "é\n2", "a/S2/T1/x.json": "", "b/S3/T2/x.json": "z", "b/S3/T2/y.json": "no", "_c/S4/T1/x.json": "no", "b/.h/T1/x.json": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = S.read_texts(spark, f"{tmp_path}/*/*/*/x.json")
    want = spark.read.text(f"{tmp_path}/*/*/*/x.json", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    assert sorted(map(tuple, got.collect())) == sorted(r for r in map(tuple, want.collect()) if "/_c/" not in r[1] and "/.h/" not in r[1])
    assert got.rdd.getNumPartitions() > 1 and "FileScan" not in got._jdf.queryExecution().executedPlan().toString()  # no index of files in the driver
    assert S.read_texts(spark, f"{tmp_path}/none/*/x.json").count() == 0 and S.read_texts(spark, f"{tmp_path}/b/S3/T2/x.json").first().value == "z"


def test_edges_are_dealt_in_parts_of_a_bounded_size(spark, monkeypatch):
    from waymark.plans import q_metrics

    data = "/root/testdata/sf0.001"
    monkeypatch.setattr(q_metrics, "_ROWS_A_TASK", 500)
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    plan = q_metrics.edges(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert f", {lines // 500}" in plan and lines // 500 > 4  # as many parts as the lines ask for, at any setting of shuffle partitions


def test_findings_of_a_row_are_put_beside_each_other(spark):
    gen = random.Random(5)
    made = [[dict(Counter((gen.choice(["backend", None]), f"r{gen.randrange(3)}", gen.choice(["f", None]), "m") for _ in range(gen.choice([0, 3, 9])))) for _ in range(3)] for _ in range(40)]
    as_items = lambda side: [({c: v for c, v in zip(diff.IDENTITY, k, strict=True)}, n) for k, n in side.items()] or None
    one = "array<struct<item:struct<scope_id:string,rule_id:string,file:string,message:string>,n:long>>"
    df = spark.createDataFrame([(i, *map(as_items, sides)) for i, sides in enumerate(made)], f"i int, now {one}, before {one}, base {one}")
    out = diff.beside_in_row(df, F.col("now"), F.col("before"), F.col("base"), "beside")
    got = {r.i: Counter((tuple(x["item"]), x["n"], x["before"], x["base"]) for x in r.beside) for r in out.collect()}
    assert got == {i: Counter((k, *[s.get(k, 0) for s in sides]) for k in set().union(*sides)) for i, sides in enumerate(made)}
    assert out.columns == ["i", "now", "before", "base", "beside"]


def test_equal_findings_of_a_document_are_counted_in_its_row(spark):
    doc = "evaluation_id string, session_id string, task_id string, task_order int, agent string, strategy string, " + S.EVALUATION.replace("task_id string, ", "")
    f = lambda rule, file, scope=None, message=None: {"rule_id": rule, "scope": scope, "location": {"file": file}, "message": message}
    held = [f("BE-A-C-1", "f.ts"), f("BE-A-C-2", "backend/f.ts"), f("BE-A-C-1", "f.ts", message=""), f(None, None), f("BE-A-C-1", "g.ts"), f(None, None)]
    scopes = [{"scope_id": s, "layers": {"constraints": {"findings": x}}} for s, x in (("backend", held), (None, held[:1]), ("frontend", None))]
    deltas = {"run_local": {"constraints": {"introduced": [f("BE-A-C-1", "f.ts", "backend")] * 3, "resolved": []}}, "trajectory_cumulative": {"constraints": {"resolved": [f("BE-A-C-1", "f.ts", None)]}}}
    docs = spark.createDataFrame([{"evaluation_id": e, "session_id": "S", "scopes": scopes, "deltas": deltas} for e in ("S/T1", "S/T2")] + [{"evaluation_id": "S/T3", "session_id": "S"}], doc)
    by = ["scope_id", "category", "file", "message"]
    kept = ["evaluation_id", *by, "delta_scope", "change_type"]
    got = ingest.build_constraint_findings(docs, by=by)
    want = ingest.build_constraint_findings(docs).groupBy(*kept).count()
    assert sorted(map(repr, got.select(*kept, "n").collect())) == sorted(map(repr, want.withColumnRenamed("count", "n").collect()))
    assert {r.n for r in got.collect()} == {1, 2, 3}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["i01_runs", "i02_constraint_findings"])
def test_documents_shuffle_findings_by_order_and_by_session_alone(spark, name):
    """Bytes shuffled and settled for a line item: 56 for i02 and 59 for i01 at sf0.01, 345 and 347 before, when documents were put together by shuffles of settled rows."""
    from waymark.functions import checkpoints
    from waymark.plans.registry import QUERIES

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    data = "/root/testdata/sf0.01"
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    start, had = written(), len(checkpoints._SETTLED.get(spark.sparkContext.applicationId, []))
    QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
    assert len(checkpoints._SETTLED.get(spark.sparkContext.applicationId, [])) == had
    assert (written() - start) / lines < 100
