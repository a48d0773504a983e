"""Nested metadata against a loop over conflicting documents."""

import json
import random

from metrifold.operators import metadata as D

SCHEMA = "pos long, source string, node string, instance string, version string, interval_ms string, systeminfo string, descriptions string, per_source string, selection string, events string"


def _load(text, kind):
    try:
        out = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return out if isinstance(out, kind) else None


def merged(inputs):
    per = {}
    names = lambda i: _load(i["source"], list) or [i["source"]]
    for i in inputs:
        for source, ids in (_load(i["per_source"], dict) or {}).items():
            for k, v in ids.items():
                per.setdefault(source, {}).setdefault(k, v)
        for source in names(i):
            key = (i["node"] or "unknown") if source == "agent" else (i["instance"] or "0")
            entry = per.setdefault(source, {}).setdefault(key, {})
            own = {"version": i["version"], "node": i["node"]} | ({} if source == "agent" else {"instance": i["instance"]})
            for k, v in own.items():
                if v is not None:
                    entry.setdefault(k, v)
        if (texts := _load(i["descriptions"], dict)) is not None:
            for source in names(i):
                per.setdefault(source, {}).setdefault("descriptions", texts)
    for i in inputs:
        info = _load(i["systeminfo"], (dict, list, str, int, float)) if i["source"] == "agent" else None
        if info is not None:
            per["agent"][i["node"] or "unknown"].setdefault("systeminfo", info)
    primary = next((i for i in inputs if i["source"] == "agent"), inputs[0])
    return {
        "sources": sorted({n for i in inputs for n in names(i)}),
        "interval_ms": next((i["interval_ms"] for i in inputs if i["interval_ms"] is not None), None),
        "systeminfo": next((i["systeminfo"] for i in inputs if i["source"] == "agent" and i["systeminfo"] is not None), None),
        "per_source": per,
        "selection": primary["selection"],
    }


def _inputs(seed):
    rnd, out = random.Random(seed), []
    pick = lambda *x: rnd.choice([None, *x])
    for pos in range(6):
        source = rnd.choice(["agent", "web", "db", '["agent", "web"]', '["db"]'])
        nested = {s: {k: {f: rnd.choice([1, "1", 2.5, None, {"deep": [1, "x"]}, 'q"t']) for f in rnd.sample(["version", "node", "cores", "x"], rnd.randrange(4))} for k in rnd.sample(["n1", "n2", "0", "descriptions"], 2)} for s in rnd.sample(["agent", "web", "old"], 2)}
        out.append({"pos": pos, "source": source, "node": pick("n1", "n2"), "instance": pick("0", "7"), "version": pick("5.1", 'a"b'), "interval_ms": pick("1000", "50"), "systeminfo": pick('{"cpus": 4, "hostname": "h"}', "torn {", "[1]"), "descriptions": pick('{"m": "help"}', '{"m": "other", "n": "more"}', "7"), "per_source": pick(json.dumps(nested), json.dumps(nested), "[]"), "selection": pick("a", "b"), "events": None})
    return out


def test_documents_merge_as_a_loop_does(spark):
    for seed in range(12):
        rows = _inputs(seed)
        r = D.merge_documents(spark.createDataFrame([tuple(i[c.split()[0]] for c in SCHEMA.split(", ")) for i in rows], SCHEMA).repartition(3)).first()
        want = merged(rows)
        assert {"sources": json.loads(r.sources), "interval_ms": r.interval_ms, "systeminfo": r.systeminfo, "per_source": json.loads(r.per_source), "selection": r.selection} == want, seed


def test_annotations_are_appended_and_normalised(spark):
    one = {"events": [{"timestamp": 5, "description": "late", "id": "a"}, {"timestamp": 9, "description": "plain"}]}
    two = {"events": [{"timestamp": 2, "description": "early", "id": "a"}, {"timestamp": 1, "description": "first"}]}
    rows = [(i, "agent", None, None, None, None, None, None, None, None, t) for i, t in enumerate([json.dumps(one), None, "torn", json.dumps(two), "{}"])]
    got = [(r.ts_ns, r.description) for r in D.merge_annotations(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(1, "first"), (2, "early"), (9, "plain")]
