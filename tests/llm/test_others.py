"""Operators on vectors and conversations, components, and the pipeline, against brute force."""

import hashlib
import json
import math
import os
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from porelane.llm import common, embeddings, toolcalls

from .test_documents import brute_jaccard, brute_substrings, check_packing

# --- components


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2050)] + [(7, 7), (-5, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tasks_have_buckets_of_their_own(spark):
    values = [common.value_of_task(t, 13) for t in range(40)]
    assert len(set(values)) == 40
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").selectExpr("pmod(hash(v), 13)").collect()]
    assert got == [t % 13 for t in range(40)]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").selectExpr("hash(v)").collect()] == common.spark_hash(np.array(values)).tolist()


def test_scratch_follows_the_session(spark):
    assert common.scratch_root(spark)
    df = common.written(spark.range(5), "x")
    assert df.count() == 5 and common.scratch_root(spark) in df._porelane_path
    common.dropped(df)
    assert not os.path.exists(df._porelane_path.removeprefix("file://"))


# --- 4 embeddings


def brute_vectors(rows, threshold=0.9):
    ok = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    link = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float64) for k in (i, j))
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                    link[i].add(j)
                    link[j].add(i)
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min(rows[j][0] for j in seen) if d is not None else None
        out.append((d, len(link[i]), low, d is None or d == low))
    return sorted(out, key=str)


def vector_rows(seed=0, groups=12, size=9, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = rng.normal(size=dim)
        rows += [(base + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.35])).tolist() for _ in range(size)]
    rows += [rng.normal(size=dim).tolist() for _ in range(150)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def check_vectors(spark, rows, kind="double", **how):
    got = embeddings.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3), **how)
    return sorted((tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_vectors_with_a_full_margin_are_exact(spark, monkeypatch):
    rows = vector_rows()
    want = brute_vectors(rows)
    assert check_vectors(spark, rows, spread=100.0) == want
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    assert check_vectors(spark, rows, spread=100.0) == want


def test_recall_of_the_usual_margin(spark):
    rows = vector_rows(3, groups=40)
    got, want = check_vectors(spark, rows), brute_vectors(rows)
    links, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want))
    assert links >= 0.9 * all_links


def test_rough_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.1, 0.2, 0.3]
    rows = [(1, v), (2, v), (2, v), (3, [0.2, 0.4, 0.6]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [None, 1.0, 1.0]), (None, v), (10, [0.1, 0.2]), (11, [1e-200, 2e-200, 3e-200]), (12, [1e200, 2e200, 3e200]), (13, [-0.1, -0.2, -0.3]), (14, [1.0]), (15, [2.0])]
    assert check_vectors(spark, rows) == brute_vectors(rows)
    assert check_vectors(spark, []) == []
    assert check_vectors(spark, [(1, None), (None, None)]) == brute_vectors([(1, None), (None, None)])


def test_the_threshold_is_exact(spark):
    half = math.acos(0.9)
    rows = [(0, [1.0, 0.0])] + [(i + 1, [math.cos(half + d), math.sin(half + d)]) for i, d in enumerate((-1e-7, 1e-7, 0.3))]
    assert check_vectors(spark, rows, spread=100.0) == brute_vectors(rows)


# --- 7 tool calls


def test_levels_cycles_and_missing_calls(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "y"), ("m", "gone"), ("n", "m"), ("s", "s"), (None, "a"), ("b", "a")]
    rows += [(f"k{i}", f"k{i - 1}" if i else None) for i in range(300)]
    got = {r["call_id"]: (r["level"], r["status"]) for r in toolcalls.levels(spark.createDataFrame(rows, "call_id string, after string")).collect()}
    want = {"a": (0, None), "b": (1, None), "c": (2, None), "x": (None, "cycle"), "y": (None, "cycle"), "z": (None, "cycle"), "m": (0, "missing call"), "n": (1, None), "s": (None, "cycle")}
    assert got == want | {f"k{i}": (i, None) for i in range(300)}
    assert toolcalls.levels(spark.createDataFrame([], "call_id string, after string")).count() == 0


def test_linked_calls(spark):
    calls = [(1, 1, "1:1", "search", None, "find me", 2), (1, 3, "1:3", "lookup", "1:1", "x" * 300, 50), (1, 5, "1:5", "nothing", None, None, None), (2, 1, "2:1", "calculate", "9:9", None, None)]
    results = [("1:1", "b"), ("1:1", "a"), ("zz", "left out"), (None, "q")]
    got = {
        r["call_id"]: r
        for r in toolcalls.linked(
            spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, after string, text string, words int"), spark.createDataFrame(results, "call_id string, content string")
        ).collect()
    }
    assert [got[c]["status"] for c in ("1:1", "1:3", "1:5", "2:1")] == ["ok", "no result", "no result", "missing call"]
    assert got["1:3"]["errors"] == "text: length above 200; words: value above 40" and got["1:5"]["errors"] == "unknown tool"
    assert got["2:1"]["errors"] == "text: missing; words: missing"
    line = json.loads(got["1:1"]["json"])
    assert line["result"] == "a" and line["arguments"] == {"text": "find me", "words": 2}
    for r in got.values():
        assert r["json"] == json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_rough_conversations(spark):
    rows = [(1, 0, "user", "q", 9), (1, 1, "assistant", None, 9), (1, 2, "user", None, 9), (1, 3, "assistant", "", 9), (1, 3, "assistant", "twice", 9), (None, 1, "assistant", "x", 9), (2, None, "assistant", "x", 9), (3, 1, None, "x", 9), (4, 1, "assistant", 'quote " \\ \n ü', 9)]
    got = toolcalls.conversation_tools(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id int")).collect()
    assert Counter(r["call_id"] for r in got) == {"1:1": 1, "1:3": 2, "4:1": 1}
    assert {r["call_id"]: r["level"] for r in got} == {"1:1": 0, "1:3": 1, "4:1": 0}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert toolcalls.conversation_tools(empty).count() == 0


def brute_levels(rows):
    """Longest ways back by plain recursion; None in or behind a cycle."""
    ups = {}
    for c, after in rows:
        ups.setdefault(c, set()).update(x for x in after or [] if x is not None)
    known, open_ = {}, set()

    def level(c):
        if c in open_:
            return None
        if c not in known:
            open_.add(c)
            below = [level(u) for u in ups[c] if u in ups]
            known[c] = None if None in below else max((x + 1 for x in below), default=0)
            open_.discard(c)
        return known[c]

    # what lies behind a cycle is seen from a fresh start for each call
    out = {}
    for c in ups:
        known.clear()
        v = level(c)
        out[c] = (v, "cycle" if v is None else "missing call" if ups[c] - set(ups) else None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_levels_of_any_graph_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(12):
        n, backward = int(rng.integers(1, 14)), 0.1 if g % 3 == 0 else 0.0
        for i in range(n):
            after = [f"{g}.{int(rng.integers(0, n) if rng.random() < backward else rng.integers(0, i))}" for _ in range(int(rng.integers(0, 4))) if i]
            rows.append((f"{g}.{i}", after + [None] * (i % 2) + ["gone"] * (rng.random() < 0.05)))
    # a ladder of calls that wait for two, fed by a chain; many that wait for one; repeats and nulls
    rows += [("l0", None), ("l1", ["l0"])] + [(f"l{i}", [f"l{i - 1}", f"l{i - 2}"]) for i in range(2, 7)] + [("l8", ["l6", "l6"]), ("l9", ["l8"])]
    rows += [(f"s{i}", ["l9", "l0"] if i % 2 else ["l9"]) for i in range(30)] + [("l0", []), ("l9", ["s0"] if seed == 2 else [])]
    got = {r["call_id"]: (r["level"], r["status"]) for r in toolcalls.levels(spark.createDataFrame([*rows, (None, ["l0"])], "call_id string, after array<string>").repartition(3)).collect()}
    assert got == brute_levels(rows)


def test_schemas_are_data(spark):
    where = {"type": "object", "properties": {"city": {"type": "string", "enum": ["Bern", "Köln"]}, "at": {"type": "array", "minItems": 2, "maxItems": 2, "items": {"type": "number", "maximum": 90}}}, "required": ["city"], "additionalProperties": False}
    schemas = {"go": {"type": "object", "properties": {"where": where, "fast": {"type": "boolean"}, "it's": {"type": "integer", "minimum": 2}}, "required": ["where", "also"]}, "free": {}}
    cases = [
        ("go", '{"where":{"city":"Köln","at":[1,2.5]},"also":null,"fast":true,"it\'s":2}', ""),
        ("go", '{"where":{"city":"Rom","at":[1,"x",95],"c":1,"b":2},"fast":0,"it\'s":1}', "where.city: not one of the values allowed; where.at: items above 2; where.at[1]: not of type number; where.at[2]: value above 90; where.b: unknown; where.c: unknown; fast: not of type boolean; it's: value below 2; also: missing"),
        ("go", '{"where":[],"also":1,"it\'s":2.5}', "where: not of type object; it's: not of type integer"),
        ("go", "[1]", "arguments: not of type object"),
        ("go", None, "where: missing; also: missing"),
        ("go", '{"a":1,"a":2}', "arguments: not JSON"),
        ("free", '{"z":[{"b":1,"a":"x"}],"a":{"d":null,"c":true}}', ""),
        (None, "{}", "unknown tool"),
        ("free", "", "arguments: not JSON"),
    ]
    rows = [(1, i, f"c{i}", n, [f"c{i - 1}", None, f"c{i - 1}", "c0"] if i else [], a, "x") for i, (n, a, _) in enumerate(cases)]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, after array<string>, arguments string, parsed string")
    got = {r["turn"]: r for r in toolcalls.linked(calls, spark.createDataFrame([("c1", "r")], "call_id string, content string"), schemas).collect()}
    assert [got[i]["errors"] for i in range(len(cases))] == [e for *_, e in cases]
    assert [got[i]["level"] for i in range(len(cases))] == list(range(len(cases))) and got[2]["after"] == ["c0", "c1"] and got[0]["after"] is None
    for i, (_, a, error) in enumerate(cases):
        line = json.loads(got[i]["json"])
        assert got[i]["json"] == json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert line.get("unparsed" if error == "arguments: not JSON" else "arguments") == (a if error == "arguments: not JSON" else a and json.loads(a))
    with pytest.raises(ValueError):
        toolcalls.linked(calls, calls.select("call_id", F.lit("x").alias("content")), {"go": {"pattern": "x"}})


def test_unlinked_results(spark):
    calls = spark.createDataFrame([("a",), ("a",), ("b",), ("n",), (None,)], "call_id string")
    results = [("a", "2"), ("a", "1"), ("a", "1"), ("a", None), ("b", "x"), ("n", None), ("n", None), ("o", "y"), ("o", "y"), (None, None)]
    got = Counter((r["call_id"], r["status"], r["json"]) for r in toolcalls.unlinked(calls, spark.createDataFrame(results, "call_id string, content string")).collect())
    line = lambda **x: json.dumps(x, separators=(",", ":"))
    again, alone = "repeated result", "orphan result"
    assert got == Counter([
        ("a", again, line(count=1, id="a", result="1", status=again)), ("a", again, line(count=1, id="a", result="2", status=again)), ("a", again, line(count=1, id="a", status=again)),
        ("n", again, line(count=1, id="n", status=again)), ("o", alone, line(count=2, id="o", result="y", status=alone)), (None, alone, line(count=1, status=alone)),
    ])
    none = spark.createDataFrame([], "call_id string, content string")
    assert toolcalls.unlinked(calls, none).count() == 0


def test_tool_calls_equal_their_sql(spark, tmp_path):
    import duckdb
    import __spark_entry__ as e

    rows = [(c, t, ("user", "assistant", "system")[(t + c // 7) % (2 + (c % 5 == 0))], f"{'wörd ' * (c * t % 90)}\t\"{t % 3}\"\n") for c in range(60) for t in range(c % 11)]
    rows += [(3, 0, "user", "again"), (4, 2, "user", "again"), (4, 2, "user", "again"), (5, 9, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(e.oracle_sql()["op7_tool_calls"])
    names = [c[0] for c in want.description]
    got = e.queries()["op7_tool_calls"](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, got.select(names).collect())) == sorted(str(r) for r in spark.createDataFrame(want.fetchall(), got.select(names).schema).collect())


def test_native_operators_run_no_python(spark):
    from porelane.llm import licenses

    turns = spark.createDataFrame([(1, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    for df in (toolcalls.conversation_tools(turns), toolcalls.conversation_links(turns), licenses.license_scan(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# --- the pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(500)]
    passage = list(rng.choice(vocabulary, 50))
    rows, marks = [], []
    for i in range(500):
        w = list(rng.choice(vocabulary, int(rng.integers(30, 120))))
        if i % 6 == 0:
            w[3:3] = ["vile"] * 3
        elif i % 5 == 0 and i > 50:
            w = rows[int(rng.integers(0, 40))][1].split()
        elif i % 7 == 0:
            w[10:10] = passage
        rows.append((i, " ".join(w), "en", f"src{i % 3}", len(" ".join(w))))
        marks.append((i, i % 2, int("vile" in w)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_every_stage_against_brute_force(spark, corpus):
    import corpus_pipeline as cp

    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    clean = common.written(cp.drop_toxic(spark, docs, path), "t")
    assert clean.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    toxic = {d for d, t, *_ in rows if "vile" in t.split()}
    assert len(toxic & set(left)) <= 0.02 * len(toxic) and len(set(left) | toxic) >= 0.98 * len(rows)
    single = common.written(cp.drop_near_copies(spark, clean, path), "s")
    want = {d for d, _, c, _ in brute_jaccard(sorted(left.items())) if d == c}
    kept = {r["doc_id"]: r["text"] for r in single.collect()}
    assert set(kept) == want and single.columns == docs.columns
    cut = common.written(cp.cut_repeated_passages(spark, single, path), "c")
    after = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == docs.columns and len(after) == len(kept)
    some = 0
    for d, _, removed, digest in brute_substrings(sorted(kept.items())):
        some += removed > 0
        assert after[d]["text"] == kept[d] if not removed else hashlib.sha256(after[d]["text"].encode()).hexdigest() == digest
        assert after[d]["n_chars"] == len(after[d]["text"])
    assert some > 5
    packed = cp.pack_sequences(spark, cut, path)
    n, least = check_packing(packed, [(d, r["text"]) for d, r in after.items()])
    assert n <= least + 1
    assert cp.run(spark, path).count() == packed.count() and cp.ORACLE_SQL is None


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    import corpus_pipeline as cp

    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil

    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{top}/porelane", tmp_path / "porelane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in [*e.queries(), *e.oracle_sql()]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.stdout.split()[1:] == ["False"] and int(out.stdout.split()[0]) > 40, out.stderr


def test_registered_queries():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert {n for n in e.oracle_sql() if n.startswith("op")} == {"op3_ngram_jaccard_join", "op5_substring_dedup", "op7_tool_calls", "op8_license_scan"}


def test_links_next_to_the_threshold_at_any_scale():
    from porelane.llm import embeddings

    # (3, 4) and (4, 3): cosine 0.96; scaled so that plain products overflow or vanish
    pair = np.array([[3.0, 4.0], [4.0, 3.0]])
    for scale in (1.0, 1e200, 1e-200, 1e300):
        assert embeddings.linked(pair * scale, 0.96).all() and not embeddings.linked(pair * scale, 0.96 + 1e-12)[0, 1]


@pytest.mark.parametrize("rows", [0, 5, 3000])
def test_least_of_each_key_with_hot_keys(spark, rows):
    # a key with a third of all rows, some with a few hundred, many with one to three
    keys = [0 if i % 3 == 0 else i % 7 if i % 3 == 1 and i % 2 else i // 3 + 10 for i in range(rows)]
    data = [(k, i * 7919 % 5003, f"x{i}") for i, k in enumerate(keys)]
    df = spark.createDataFrame(data, "k long, v long, rest string").repartition(4)
    least = {}
    for k, v, _ in data:
        least[k] = min(v, least.get(k, v))
    got = common.with_least(df, "k", F.col("v"), "low")
    assert Counter(tuple(r) for r in got.select("k", "v", "rest", "low").collect()) == Counter((k, v, x, least[k]) for k, v, x in data)
