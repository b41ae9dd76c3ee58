import datetime
import gzip
import json

import numpy as np
import pytest
from conftest import HOURLY, hourly_rows, price_days
from pyspark.sql import functions as F

from loomgrid.config import SeriesSpec
from loomgrid.operators import coverage
from loomgrid.sources import bronze, catalog, silver
from loomgrid.streaming import ingest

HEADER = (
    "Sistema,Centro de Control Regional,Zona de Carga,Clave,Nombre,Nivel de Tensión (kV),"
    "Directamente  Modelada,Indirectamente Modelada,Directamente Modelada,Indirectamente Modelada,"
    "Zona de Operación de Transmisión,Gerencia Regional de Transmisión,Zona de Distribución,"
    "Gerencia Divisional de Distribución,Clave de Entidad Federativa (INEGI),"
    "Entidad Federativa (INEGI),Clave de Municipio (INEGI),Municipio (INEGI),Región de Transmisión"
)


def catalog_line(node, region="NORTE", zone="Z1", kv="115", system="SIN", flags=("X", "", "No", "1")):
    return f"{system},{region},{zone},{node},Name {node},{kv},{','.join(flags)},T,M,D,V,12,State,3,Town,R"


@pytest.fixture(scope="module")
def catalog_file(tmp_path_factory):
    lines = [HEADER, catalog_line(" B "), catalog_line("A", region="No Aplica", zone=" "),
             catalog_line("B", zone="later"), catalog_line(""), catalog_line("C", kv="34.5"),
             catalog_line("D", kv="n/d", system="BCA")]
    path = tmp_path_factory.mktemp("cat") / "Nodes v2024-03-05.csv"
    path.write_bytes(("﻿" + "\n".join(lines)).encode("utf-8"))
    return str(path)


def test_catalog_file(spark, catalog_file):
    rows = {r["node"]: r for r in catalog.read_catalog(spark, catalog_file).collect()}
    assert list(rows) == ["A", "B", "C", "D"]
    b = rows["B"]
    assert (b["zone"], b["catalog_version"], b["kv"], b["state_code"]) == ("Z1", "20240305", 115.0, 12)
    assert (b["load_direct"], b["load_indirect"], b["gen_direct"], b["gen_indirect"]) == (
        True, False, False, True)
    assert (rows["A"]["region"], rows["A"]["zone"]) == ("UNKNOWN", "UNKNOWN")
    assert rows["C"]["kv"] == 34.5 and rows["D"]["kv"] is None
    with pytest.raises(ValueError):
        catalog.column_positions(["CLAVE"])
    with pytest.raises(ValueError):
        catalog.read_catalog(spark, "/tmp/no-version.csv")


def test_catalog_versions(spark, catalog_file, tmp_path):
    path = str(tmp_path / "catalog")
    catalog.save_catalog(catalog.read_catalog(spark, catalog_file), path)
    newer = catalog.read_catalog(spark, catalog_file, "20250101").where("node <> 'A'")
    catalog.save_catalog(newer, path)
    assert catalog.stored_catalog(spark, path).count() == 3
    assert catalog.stored_catalog(spark, path, "20240305").count() == 4


def test_node_lists(spark, tmp_path, three_nodes):
    named, bare = tmp_path / "named.csv", tmp_path / "bare.csv"
    named.write_text("region,node\nx, A \ny,B\n")
    bare.write_text("A,1\n\nB,2\n")
    for path in (named, bare):
        assert sorted(r["node"] for r in catalog.read_node_list(spark, str(path)).collect()) == ["A", "B"]
    out = str(tmp_path / "list")
    catalog.write_node_list(three_nodes, out)
    back = spark.read.option("header", True).csv(out).collect()
    assert [r["node"] for r in back] == ["DAM-1", "KITE-2", "SUN-3"]


def greedy(rows, quotas):
    """Pick one node at a time, as the selection rule is stated."""
    picked, by_region, by_zone = [], {}, {}
    for kv in sorted(quotas, reverse=True):
        pool = [r for r in rows if r[3] == kv]
        for _ in range(len(pool) if quotas[kv] == "all" else min(quotas[kv], len(pool))):
            key = lambda r: (by_region.get((r[1], kv), 0), by_zone.get(r[2], 0), r[0])
            best = min(pool, key=key)
            pool.remove(best)
            picked.append(best[0])
            by_region[(best[1], kv)] = by_region.get((best[1], kv), 0) + 1
            by_zone[best[2]] = by_zone.get(best[2], 0) + 1
    return sorted(picked)


@pytest.mark.parametrize("seed", range(4))
def test_selection_equals_the_greedy_rule(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(60):
        region = f"R{rng.integers(0, 4)}"
        zone = f"{region}-Z{rng.integers(0, 3)}"
        rows.append((f"N{i:03d}", region, zone, float(rng.choice([400, 230, 115]))))
    quotas = {400.0: "all" if seed % 2 else 7, 230.0: 9, 115.0: 11}
    frame = spark.createDataFrame(
        [(n, "SIN", r, z, k) for n, r, z, k in rows],
        "node string, sistema string, region string, zone string, kv double")
    got = sorted(r["node"] for r in catalog.select_nodes(frame, quotas).collect())
    assert got == greedy(rows, quotas)


def test_selection_needs_nested_zones(spark):
    frame = spark.createDataFrame(
        [("A", "SIN", "R1", "Z", 115.0), ("B", "SIN", "R2", "Z", 115.0)],
        "node string, sistema string, region string, zone string, kv double")
    with pytest.raises(ValueError):
        catalog.select_nodes(frame, {115: 1})


def body(node, day, hours, **extra):
    values = [{"fecha": day, "hora": str(h), "pml": f"{1000 + h:,}.5", "pml_ene": "", "pml_per": "1",
               "pml_cng": "x"} for h in hours]
    return json.dumps({"nombre": "PML", "Resultados": [{"clv_nodo": node, "Valores": values}], **extra})


CASES = [
    ("ok", 200, body("A", "2024-01-05", [1, 2]), "ok", 2, None),
    ("list", 200, '[{"nodo": " A ", "valores": [{"fecha": "2024-01-05T00", "hora": 3.0, "pml": 5}]}]', "ok", 1, None),
    ("nested", 200, '{"resultados": [{"clave": "A", "Valores": [{"hora": "1"}, {"fecha": "2024-01-05", "hora": "z"}]}]}',
     "empty", 0, None),
    ("message", 200, '{"Message": "no data"}', "message", 0, "no data"),
    ("wording", 200, '{"x": 1, "aviso": "No se pueden ver"}', "message", 0, "No se pueden ver"),
    ("blank", 204, "  ", "empty", 0, None),
    ("none", 200, None, "empty", 0, None),
    ("broken", 200, "{oops", "message", 0, "invalid json"),
    ("scalar", 200, "5", "message", 0, "unexpected payload"),
    ("missing", 404, None, "not_found", 0, None),
    ("busy", 429, body("A", "2024-01-05", [1]), "error", 1, None),
    ("down", 503, None, "error", 0, None),
    ("lost", None, None, "error", 0, None),
    ("odd", 302, body("A", "2024-01-05", [1]), "error", 1, None),
    ("no node", 200, '{"Resultados": [{"Valores": [{"fecha": "2024-01-05", "hora": "1"}]}]}', "empty", 0, None),
]


def test_bodies_and_events(spark):
    frame = spark.createDataFrame([c[:3] for c in CASES], "name string, status_code int, body string")
    parsed = bronze.parse_bodies(frame)
    out = {r["name"]: r for r in bronze.classify(parsed).collect()}
    for name, _, _, event, n, message in CASES:
        assert (out[name]["event"], out[name]["n_records"], out[name]["message"]) == (event, n, message), name
    records = {(r["name"], r["hora"]): r for r in bronze.explode_records(parsed, ["name"]).collect()}
    first = records[("ok", 1)]
    assert (first["node"], first["fecha"], first["pml"]) == ("A", "2024-01-05", 1001.5)
    assert first["pml_ene"] is None and first["pml_per"] == 1.0 and first["pml_cng"] is None
    assert records[("list", 3)]["node"] == "A" and records[("list", 3)]["fecha"] == "2024-01-05"
    summary = {r["event"]: r for r in bronze.collection_summary(bronze.classify(parsed)).collect()}
    assert summary["error"]["n_requests"] == 4 and summary["ok"]["n_records"] == 3


def envelope(folder, name, market="MDA", zipped=True, **fields):
    base = {"sistema": "SIN", "proceso": market, "nodes": ["A"], "start": "2024-01-05",
            "end": "2024-01-06", "status_code": 200, "attempts": 1, "body": None}
    text = json.dumps({**base, **fields})
    folder.mkdir(parents=True, exist_ok=True)
    if zipped:
        with gzip.open(folder / f"{name}.json.gz", "wt", encoding="utf-8") as handle:
            handle.write(text)
    else:
        (folder / f"{name}.json").write_text(text)


def test_envelopes_rebuild_and_index(spark, tmp_path):
    root = tmp_path / "bronze"
    full = list(range(1, 25))
    envelope(root / "SIN/MDA/2024", "a", body=body("A", "2024-01-05", full))
    later = body("A", "2024-01-05", full).replace('"1,0', '"9,0')
    envelope(root / "SIN/MDA/2024", "b", body=later, zipped=False)
    envelope(root / "SIN/MDA/2024", "c", body=body("A", "2024-01-06", [1, 2, 6]))
    envelope(root / "SIN/MTR/2024", "d", market="MTR", body=body("A", "2024-01-05", full))
    (root / "SIN/MDA/index.jsonl").write_text("{}\n")
    rows = bronze.read_envelopes(spark, str(root))
    assert rows.count() == 4
    mda = bronze.read_envelopes(spark, str(root), "SIN", "MDA")
    assert mda.count() == 3
    built = bronze.rebuild_silver(mda, HOURLY)
    by = {(r["fecha"].day, r["hora"]): r for r in built.collect()}
    assert len(by) == 48 and by[(5, 1)]["pml"] == 1001.5
    assert by[(6, 4)]["quality"] == "interp" and by[(6, 7)]["quality"] == "missing"
    assert by[(6, 4)]["pml"] == pytest.approx(1004.5)
    index = bronze.request_index(mda).collect()
    assert "body" not in index[0].asDict() and all(r["has_body"] for r in index)
    assert index[0]["key"].startswith("20240105-20240106__1n_")


SERIES = SeriesSpec(keys=("market", "node"))


def test_merge_is_idempotent_and_keeps_stored_rows(spark, tmp_path):
    path = str(tmp_path / "silver")
    start = datetime.date(2024, 1, 1)
    week1 = hourly_rows(spark, price_days("A", start, 7, seed=1) + price_days("B", start, 7, seed=2))
    silver.upsert_silver(spark, path, week1, SERIES)
    read = lambda **kw: silver.read_silver(spark, path, **kw).orderBy("node", "ts_local")
    columns = ["node", "ts_local", "pml", "quality"]
    once = read().select(*columns).collect()
    assert len(once) == 2 * 168
    changed = week1.where("node = 'A'").withColumn("pml", F.lit(-1.0))
    silver.upsert_silver(spark, path, changed, SERIES)
    assert read().select(*columns).collect() == once
    week3 = hourly_rows(spark, price_days("A", start + datetime.timedelta(days=14), 7, seed=3))
    silver.upsert_silver(spark, path, week3, SERIES)
    a = read(nodes=["A"])
    assert a.count() == 504 and a.where("quality = 'missing'").count() == 168
    assert coverage.complete_blocks(a, HOURLY).count() == 14
    table = coverage.coverage_table(a, HOURLY).first()
    assert (table["days"], table["full_days"]) == (21, 14)
    assert read(nodes=["B"]).count() == 168
    part = read(nodes=["A"], start="2024-01-03", end="2024-01-04", columns=["node", "ts_local"])
    assert part.count() == 48 and part.columns == ["node", "ts_local"]
    last = coverage.trailing_days(a, 2).agg(F.min("fecha")).first()[0]
    assert last == datetime.date(2024, 1, 20)


def test_a_failed_write_leaves_the_state_before_it(spark, tmp_path, monkeypatch):
    path, start = str(tmp_path / "silver"), datetime.date(2023, 12, 30)
    first = hourly_rows(spark, price_days("A", start, 4, seed=1))
    more = hourly_rows(spark, price_days("A", start + datetime.timedelta(days=4), 2, seed=2))
    silver.upsert_silver(spark, path, first, SERIES)
    state = lambda **kw: sorted(map(tuple, silver.read_silver(spark, path, **kw).select("ts_local", "pml").collect()))
    before = state()
    open_reader = silver.read_silver(spark, path)
    with monkeypatch.context() as broken:
        broken.setattr(silver, "_publish", lambda *x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            silver.upsert_silver(spark, path, more, SERIES)
    assert state() == before and silver.versions(spark, path) == [1]
    silver.upsert_silver(spark, path, more, SERIES)
    assert len(state()) == 144 and state(version=1) == before
    # a reader that began before the write still reads what it saw
    assert open_reader.count() == 96
    assert silver.read_silver(spark, path, start="2030-01-01").count() == 0
    other = hourly_rows(spark, price_days("A", datetime.date(2024, 1, 5), 1, seed=3))
    silver.upsert_silver(spark, path, other, SERIES)
    whole = state()
    silver.drop_old_versions(spark, path)
    assert state() == whole and silver.versions(spark, path) == [3]
    with pytest.raises(RuntimeError, match="another write"):
        silver._publish(spark, path, 3, {})


def test_reads_prune_partitions(spark, tmp_path):
    path = str(tmp_path / "silver")
    rows = hourly_rows(spark, price_days("A", datetime.date(2023, 12, 30), 5))
    silver.upsert_silver(spark, path, rows, SERIES)
    one = silver.read_silver(spark, path, nodes=["A"], start="2024-01-01", columns=["pml"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(market" in scan and "bucket" in scan and "year" in scan
    assert "EqualTo(node,A)" in scan and "pml_ene" not in scan


def test_stream_picks_up_new_envelopes(spark, tmp_path):
    root, path, state = tmp_path / "bronze", str(tmp_path / "silver"), str(tmp_path / "state")
    full = list(range(1, 25))
    seen = []
    run = lambda: ingest.ingest(
        spark, str(root), path, state, after=lambda df, i: seen.append(i)).awaitTermination(120)
    envelope(root / "SIN/MDA/2024", "a", body=body("A", "2024-01-05", full))
    envelope(root / "SIN/MDA/2024", "b", body='{"Message": "later"}')
    run()
    rows = silver.read_silver(spark, path)
    assert rows.count() == 24
    # a day published late, and a repeat of the first day with other prices
    envelope(root / "SIN/MDA/2024", "c", body=body("A", "2024-01-07", full))
    envelope(root / "SIN/MDA/2024", "d", body=body("A", "2024-01-05", full).replace('"1,0', '"7,0'))
    run()
    rows = silver.read_silver(spark, path)
    by = {(r["fecha"].day, r["hora"]): r for r in rows.collect()}
    assert len(by) == 72 and by[(5, 1)]["pml"] == 1001.5
    assert {by[(6, h)]["quality"] for h in full} == {"missing"}
    run()
    assert silver.read_silver(spark, path).count() == 72
    assert seen == [0, 1]


def test_records_of_a_body_are_shuffled_and_sorted_once(spark):
    again = body("A", "2024-01-05", [1, 2]).replace("1001.5", "7.0")
    rows = [("a", "SIN", "MDA", body("A", "2024-01-05", [2, 1])), ("b", "SIN", "MDA", again)]
    frame = spark.createDataFrame(rows, "path string, sistema string, proceso string, body string")
    out = bronze.envelope_rows(frame, HOURLY)
    assert sorted((r["node"], r["hora"]) for r in out.collect()) == [("A", 1), ("A", 1), ("A", 2), ("A", 2)]
    plan = bronze.envelope_rows(frame, HOURLY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count(" Sort [") == 1
