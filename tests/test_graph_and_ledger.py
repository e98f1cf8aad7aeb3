import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import graph, ledger, snapshots
from codeloom.streaming import ledger as stream


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source string, target string")


def cycles(spark, *pairs):
    return sorted(r.message for r in graph.import_cycles(edges(spark, *pairs)).collect())


def test_cycles(spark):
    assert cycles(spark, ("a.py", "b.py"), ("b.py", "a.py"), ("b.py", "c.py")) == ["Import cycle includes 2 files: a.py, b.py."]
    assert cycles(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("z", "z")) == ["Import cycle includes 1 file: z.", "Import cycle includes 3 files: a, b, c."]
    assert cycles(spark, *[(f"n{i:03}", f"n{i + 1:03}") for i in range(12)]) == []


def test_random_components(spark):
    rnd = random.Random(5)
    pairs = [(f"n{rnd.randrange(14):02}", f"n{rnd.randrange(14):02}") for _ in range(19)]
    reach = {x: {x} for p in pairs for x in p}
    for _ in range(20):
        for a, b in pairs:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {}
    for x in reach:
        own = frozenset(y for y in reach if y in reach[x] and x in reach[y])
        if len(own) > 1 or (x, x) in pairs:
            want[x] = min(own)
    for one_task in (graph.ONE_TASK, 4, 0):
        assert {r.node: r.component for r in graph.strong_components(edges(spark, *pairs), one_task).collect()} == want


def test_expansion(spark):
    e = spark.createDataFrame([("a", "b", "imports"), ("b", "a", "imports"), ("b", "c", "imports"), ("a", "b", "imports")], "source string, target string, relation string")
    shown = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    got = {r.node: r.hop for r in graph.expand(e, seeds, shown, max_hops=2).collect()}
    assert got == {"b": 1, "c": 2}
    few = graph.expand(e, seeds, shown, max_hops=2, per_seed=1).collect()
    assert [(r.node, r.relation, r.direction) for r in few] == [("b", "imports", "forward")]
    assert graph.expand(e, seeds, shown, relations=("contains",)).count() == 0
    back = graph.expand(e, spark.createDataFrame([("c",)], "seed string"), shown, signals=[("imports", "forward")])
    assert back.count() == 0
    with pytest.raises(ValueError):
        graph.steps(e, signals=[])


def test_imports_resolve_only_by_whole_name(spark):
    files = spark.createDataFrame([("shop/cart.py",), ("shop/pay/card.py",), ("twin/x.py",), ("twin/x/__init__.py",), ("shop/pay/__init__.py",), ("j/A.java",)], "relative_path string")
    rows = [("shop/pay/card.py", t) for t in ("json", "..cart", "twin.x", ".....far", ".", "shop.cart")] + [("shop/pay/__init__.py", "..cart"), ("j/A.java", "shop.cart"), ("j/A.java", "j.A")]
    types = spark.createDataFrame([("j.A", "j/A.java"), ("j.B", "j/A.java"), ("j.B", "j/B.java")], "target string, resolved string")
    got = {tuple(r) for r in graph.resolve_imports(spark.createDataFrame(rows, "importer string, target string"), files, types).collect()}
    card, init = "shop/pay/card.py", "shop/pay/__init__.py"
    assert got == {
        (card, "json", None), (card, "shop.cart", "shop/cart.py"), (card, "twin.x", None), (card, "unresolved-relative:shop.pay:5:far", None), (card, "shop.pay", init),
        (init, "shop.cart", "shop/cart.py"), ("j/A.java", "shop.cart", None), ("j/A.java", "j.A", "j/A.java"),
    }


def test_snapshot_checks(spark):
    old = spark.createDataFrame([("a", "python", "1"), ("b", "java", "2")], "relative_path string, language string, content_hash string")
    snapshots.validate_files(old, old.unionByName(spark.createDataFrame([("c", "x", "3")], old.schema)))
    with pytest.raises(ValueError):
        snapshots.validate_files(old, old.limit(1))
    with pytest.raises(ValueError):
        snapshots.compare_snapshots("p", "q", old, old, ["relative_path"], ["content_hash"])
    assert snapshots.guarded(lambda: old, lambda x: x, old).count() == 2


def test_only_changes_are_embedded(spark):
    old = spark.createDataFrame([(f"s{i}", str(i)) for i in range(60)], "id string, content_hash string")
    new = spark.createDataFrame([(f"s{i}", str(i) + ("x" if i in (1, 2, 3) else "")) for i in range(60) if i not in (10, 11)] + [("t1", "t"), ("t2", "t")], "id string, content_hash string")
    seen = []

    def embed(rows):
        seen.append(rows.count())
        return rows.withColumn("vector", F.array(F.length("content_hash").cast("double")))

    index = snapshots.update_vectors(embed(old), new, embed)
    assert seen[1] == 5 and sorted(map(tuple, index.collect())) == sorted(map(tuple, embed(new).collect()))


OPS = "account_id string, seq long, op string, request_id string, amount long, note string"


def plain_fold(rows):
    out, state = {}, {}
    for a, seq, op, request, amount, note in sorted(rows, key=lambda r: r[1]):
        balance, done = state.setdefault(a, [0, {}])
        signed, key = (-amount if op == "charge" else amount), ((op, request) if op in ("charge", "refund") else None)
        if amount == 0 or (op != "adjust" and amount < 0) or (key and not request):
            status = "invalid"
        elif key in done:
            status = "replayed" if done[key] == (amount, note) else "conflict"
        elif op in ("charge", "adjust") and balance + signed < 0:
            status = "rejected"
        else:
            status = "applied"
            state[a][0] += signed
            if key:
                done[key] = (amount, note)
        out[seq] = (status, state[a][0])
    return out


def test_ledger_fold(spark):
    rows = [("u", 1, "grant", None, 20, ""), ("u", 2, "charge", "r", 7, ""), ("u", 3, "refund", "r", 2, ""), ("u", 4, "adjust", None, -3, ""), ("u", 5, "charge", "r", 7, ""), ("u", 6, "charge", "r", 8, ""), ("u", 7, "charge", "q", 99, "")]
    got = {r.seq: (r.status, r.balance) for r in ledger.apply_operations(spark.createDataFrame(rows, OPS)).collect()}
    assert got[4] == ("applied", 12) and got[5] == ("replayed", 12) and got[6] == ("conflict", 12) and got[7] == ("rejected", 12)


def test_random_folds(spark):
    rnd = random.Random(7)
    rows = [(f"u{rnd.randrange(4)}", i, rnd.choice(ledger.OPERATIONS), rnd.choice([None, "a", "b", "c"]), rnd.randrange(-5, 30), rnd.choice(["", "x"])) for i in range(300)]
    got = {r.seq: (r.status, r.balance) for r in ledger.apply_operations(spark.createDataFrame(rows, OPS)).collect()}
    assert got == plain_fold(rows)


def test_reservations(spark):
    rows = [("u", 1, "grant", None, 10), ("u", 2, "reserve", "a", 8), ("u", 3, "reserve", "b", 8), ("u", 4, "finalize", "a", 8), ("u", 5, "finalize", "a", 8), ("u", 6, "reserve", "c", 2), ("u", 7, "finalize", "c", 3), ("u", 8, "fail", "c", 0)]
    df = spark.createDataFrame(rows, "account_id string, seq long, event string, request_id string, amount long")
    got = {r.seq: (r.status, r.available) for r in ledger.managed_requests(df).collect()}
    assert got == {1: ("GRANTED", 10), 2: ("RESERVED", 2), 3: ("REFUSED", 2), 4: ("SUCCEEDED", 2), 5: ("ignored", 2), 6: ("RESERVED", 0), 7: ("FINALIZATION_FAILED", 0), 8: ("FAILED", 2)}


def test_stream_keeps_first_writes(spark, tmp_path):
    schema = "ts timestamp, type string, account_id string, request_id string, amount long"
    rows = spark.sql("select timestamp'2024-01-01' ts, 'usage' type, 'u' account_id, cast(id % 3 as string) request_id, -1L amount from range(9)")
    rows.write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stream.first_writes(events).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from firsts").count() == 3


def test_stream_maintains_an_index(spark, tmp_path):
    schema = "id string, h string"
    old = spark.createDataFrame([("a", "1"), ("b", "2")], schema)
    spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], schema).write.parquet(str(tmp_path / "in"))
    seen = []
    batch = stream.maintain_index(lambda: old, lambda changes: seen.extend(map(tuple, changes.collect())), ["id"], ["h"])
    q = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [("b", "changed"), ("c", "added")]
