from fleetspark.operators.leases import bounded_allocation, keep_per_match, lookup_last, map_from_rows, nth_rows
from tests.conftest import rows

ALLOC_SCHEMA = "resource_id string, reservations array<struct<id:string,lease_id:string>>, ord int"


def test_parent_once_per_matching_element(spark):
    allocs = spark.createDataFrame([("h1", [("r1", "L"), ("r2", "L")], 1), ("h2", [("r3", "M")], 2)], ALLOC_SCHEMA)
    per = keep_per_match(allocs, "reservations", lambda r: r["lease_id"] == "L")
    assert rows(per, "resource_id") == [("h1",), ("h1",)]
    once = keep_per_match(allocs, "reservations", lambda r: r["lease_id"] == "L", set_form=True)
    assert rows(once, "resource_id") == [("h1",)]


def test_lookup_last_wins_and_keeps_missing(spark):
    hosts = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "id string, hostname string, ord int")
    allocs = spark.createDataFrame([("a",), ("c",)], "resource_id string")
    out = lookup_last(allocs, hosts, "resource_id", "id", ["hostname"], "ord")
    assert rows(out, "resource_id", "hostname") == [("a", "y"), ("c", None)]
    # the shuffle path (no broadcast) gives the same answer
    out2 = lookup_last(allocs, hosts, "resource_id", "id", ["hostname"], "ord", max_broadcast_rows=0)
    assert rows(out2, "resource_id", "hostname") == [("a", "y"), ("c", None)]


def test_map_from_rows_last_duplicate_wins(spark):
    df = spark.createDataFrame([("g", "k1", "v1", 1), ("g", "k1", "v2", 2), ("g", "k2", "v3", 1)],
                               "g string, k string, v string, o int")
    m = map_from_rows(df, ["g"], "k", "v", "o").first()["m"]
    assert m == {"k1": "v2", "k2": "v3"}


def test_bounded_allocation(spark):
    data = [("g1", 1)] + [("g2", i) for i in range(2)] + [("g5", i) for i in range(5)]
    df = spark.createDataFrame(data, "g string, i int")
    out = bounded_allocation(df, ["g"], ["i"], 2, 3)
    got = {}
    for r in out.collect():
        got.setdefault(r["g"], []).append(r["i"])
    assert "g1" not in got and sorted(got["g2"]) == [0, 1] and sorted(got["g5"]) == [0, 1, 2]


def test_nth_rows_empty_when_short(spark):
    df = spark.createDataFrame([("c", 10), ("c", 20)], "c string, v int")
    out = nth_rows(df, ["c"], ["v"], [0, 1, 2], ["v"])
    assert rows(out, "idx", "v") == [(0, 10), (1, 20), (2, None)]


def test_json_listings_scan(spark, tmp_path):
    import json

    from fleetspark.functions.jsonx import decode_inner
    from fleetspark.sources.listings import ALLOCATIONS_SCHEMA, HOSTS_SCHEMA, host_map, read_listing
    (tmp_path / "hosts.json").write_text(json.dumps([
        {"id": "1", "hypervisor_hostname": "c01", "node_type": "gpu_large"},
        {"id": "2", "hypervisor_hostname": "c02", "node_type": "compute_skylake"},
        {"id": "1", "hypervisor_hostname": "c01b", "node_type": "gpu_large"}]))
    (tmp_path / "allocs.json").write_text(json.dumps([
        {"resource_id": "1", "reservations": [{"id": "r1", "lease_id": "L"}, {"id": "r2", "lease_id": "L"}]},
        {"resource_id": "3", "reservations": [{"id": "r3", "lease_id": "L"}]}]))
    (tmp_path / "lease.json").write_text(json.dumps(
        {"id": "L", "name": "n", "reservations": json.dumps({"id": "res-9"}), "start_date": "", "end_date": ""}))
    hosts = read_listing(spark, str(tmp_path / "hosts.json"), HOSTS_SCHEMA)
    assert hosts.count() == 3
    hm = host_map(hosts)
    allocs = read_listing(spark, str(tmp_path / "allocs.json"), ALLOCATIONS_SCHEMA)
    mine = keep_per_match(allocs, "reservations", lambda r: r["lease_id"] == "L")
    looked = mine.join(hm, mine.resource_id == hm.key, "left")
    assert rows(looked, "resource_id", "value") == [("1", "c01b"), ("1", "c01b"), ("3", None)]
    lease = spark.read.text(str(tmp_path / "lease.json"), wholetext=True)
    assert lease.select(decode_inner("value", "$.reservations", "id string")["id"]).first()[0] == "res-9"
