"""Objects of JSON documents that are read in splits, against a parser of whole documents."""

import json
import random

import pytest

from perfloom.sources import documents as D
from perfloom.sources import read

WORDS = ["a", "}", "{", "x}y", "\\", '"', "]", "é\n", '{"a":[', "k,:", '\\"}']


def made(rng, depth):
    r = rng.random()
    if depth <= 0 or r < 0.3:
        return rng.choice([1, None, True, "s", 2.5, *WORDS])
    if r < 0.6:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(WORDS) + str(k): made(rng, depth - 1) for k in range(rng.randrange(4))}


def cut(text, sizes, under, kind="["):
    """What the tasks do, with splits of the given numbers of pieces."""
    pieces = text.split("}")
    pieces = pieces[: -1 if pieces[-1] == "" else None]
    state, found, open_part, first = [None, []], [], None, 0
    for n in sizes:
        part, pieces = pieces[:n], pieces[n:]
        summary, cutter = D._Summaries("f", first), D._Cutter("f", first, json.loads(json.dumps(state)), kind, under)
        rows = []
        for k, piece in enumerate(part):
            list(summary.add(first + k, piece))
            rows += cutter.add(first + k, piece)
        for _, _, seq, keys, out, ends in [*rows, *cutter.end()]:
            open_part = (keys, out) if seq is not None else (open_part[0], open_part[1] + out)
            if ends:
                found.append((open_part[0], json.loads(open_part[1])))
        state = D._after(state, next(summary.end())[2])
        first += 1000
    return found


def test_cutting_at_any_place_finds_every_object():
    rng = random.Random(7)
    for _ in range(1500):
        events = [made(rng, 4) for _ in range(rng.randrange(12))]
        doc = rng.choice([events, {"a}b": made(rng, 3), "traceEvents": events, "z": made(rng, 3)}, {rng.choice(WORDS): made(rng, 2), "traceEvents": made(rng, 3)}])
        text = json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        sizes = [*(rng.randrange(1, 6) for _ in range(20)), 10_000]
        inner = doc.get("traceEvents") if isinstance(doc, dict) else doc
        assert [x for _, x in cut(text, sizes, [(), ("traceEvents",)])] == [e for e in (inner if isinstance(inner, list) else []) if isinstance(e, dict)]
        want = [([a, b, c], z) for a, x in doc.items() if isinstance(x, dict) for b, y in x.items() if isinstance(y, dict)
                for c, z in y.items() if isinstance(z, dict)] if isinstance(doc, dict) else []
        assert cut(text, sizes, [(None, None)], "{") == want


@pytest.fixture
def small_splits(spark):
    """Splits of 20 kB."""
    keys = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1000"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_one_line_document_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(1)
    events = [{"name": f"e{k}", "ts": k, "ph": "X", "pid": 1, "tid": 2, "args": {"deep": made(rng, 4), "k": k}} for k in range(6000)]
    events[3000]["args"]["long"] = 'x"}{,' * 30_000  # one object over several splits
    for name, doc in (("t1", events), ("t2", {"meta": {"traceEvents": [{"name": "no"}]}, "traceEvents": events, "more": [{"ts": 1}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "t3.json").write_text(json.dumps(events[:50])[:-1])  # broken off
    found = D.json_objects(spark, str(tmp_path), [(), ("traceEvents",)])
    assert D._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 60
    rows = found.collect()
    for name, want in (("t1", events), ("t2", events), ("t3", events[:50])):
        own = sorted((r for r in rows if r.file.endswith(f"{name}.json")), key=lambda r: r.seq)
        assert len({r.seq for r in own}) == len(own)
        assert [json.loads(r.text) for r in own] == want
    got = read(spark, "chrome", str(tmp_path / "t1.json")).orderBy("seq").select("ts", "name").collect()
    assert [(r.ts, r.name) for r in got] == [(e["ts"], e["name"]) for e in events]


def test_nested_documents_in_splits(spark, tmp_path, small_splits):
    times = {"communication_time_info": {"wait_time_ms": 1.0, "transit_time_ms": 2.0}}
    doc = {f"g}}{g}": {f"step{s}": {f"op{o}@{g}": dict(times, rank_id=o) for o in range(60)} for s in range(10)} for g in range(4)}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    rows = read(spark, "comm_time", str(tmp_path / "c.json")).collect()
    want = {(g, s, o.split("@")[0], x["rank_id"]) for g, a in doc.items() for s, b in a.items() for o, x in b.items()}
    assert len(rows) == 2400 and {(r.group, r.step, r.op_name, r.rank) for r in rows} == want and {r.elapsed for r in rows} == {3.0}
    links = {"(0)": {"step1": {f"op{o}@1": {f"{a}-{b}": {"Bandwidth(GB/s)": 1.5} for a in range(8) for b in range(8)} for o in range(40)}}}
    (tmp_path / "m.json").write_text(json.dumps(links))
    rows = read(spark, "comm_matrix", str(tmp_path / "m.json")).collect()
    assert {(r.op_name, r.src, r.dst) for r in rows} == {(f"op{o}", a, b) for o in range(40) for a in range(8) for b in range(8)} and len(rows) == 2560


def test_step_records_of_either_key(spark, tmp_path):
    for name, doc in (("a", {"steps": [{"step_id": 1, "start_time": 5}], "traceEvents": [{"step_id": 9}]}), ("b", {"traceEvents": [{"step_id": 2, "ts": 7}]}),
                      ("c", [{"iteration": 3, "ts": 8}, 5, None])):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "d.json").write_text("")
    got = read(spark, "step_json", str(tmp_path)).collect()
    assert sorted((r.trace_id, r.name, r.ts) for r in got) == [("a", "Step#1", 5), ("b", "Step#2", 7), ("c", "Step#3", 8)]


def test_documents_are_cut_once(spark, tmp_path, capsys):
    (tmp_path / "d.json").write_text(json.dumps({"traceEvents": [{"name": f"e{i}", "ts": i} for i in range(50)]}))
    got = D.json_objects(spark, str(tmp_path / "d.json"), [("traceEvents",)])
    got.explain()
    assert "MapInArrow" not in capsys.readouterr().out and "Arrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert [json.loads(r.text)["ts"] for r in got.orderBy("seq").collect()] == list(range(50))
