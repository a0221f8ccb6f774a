import json

from kinloom.operators import consolidate as c

SCHEMA = "file_key string, body string"
P = "s3://b/x/p.tar"


def run(spark, rows, target=1 << 20):
    return consolidate_rows(spark.createDataFrame(rows, SCHEMA), target)


def consolidate_rows(df, target):
    return c.merge_runs(c.parse_records(df), target)


def line(path, det=0.5):
    return f'{{"person_id": 1, "aligned_s3_path": "{path}", "det": {det}}}'


def test_formats_spellings_and_cut_lines(spark):
    rows = [
        ("a.jsonl", line(f"{P}/1.jpg") + "\r\n" + line(f"{P}/2.jpg")),
        ("b.csv", f'person_id,aligned_s3_path,det\n1," S3A://b/x//p.tar/./1.jpg ",0.25\n1,"{P}/3.jp'),
        ("c.csv", f"det,person_id,aligned_s3_path\n0.5,7,{P}/4.jpg\n0.5,7"),
        ("d.json", '{"aligned_s3_path":"s3://b/x/p%2Etar/2.jpg","det":0.1,"person_id":"9"}\n{"aligned_s3_path":"s3://b/x/p.tar/5.jpg","det":0.'),
        ("e", None),
        ("f", ""),
        ("g", "person_id,aligned_s3_path,det"),
        ("h", f"1,{P}/6.jpg,"),
    ]
    m = run(spark, rows)
    got = {(r.obj, r.file_key, r.person_id) for r in m.collect()}
    assert got == {(f"{P}/1.jpg", "a.jsonl", 1), (f"{P}/2.jpg", "a.jsonl", 1), (f"{P}/1.jpg", "b.csv", 1), (f"{P}/4.jpg", "c.csv", 7), (f"{P}/2.jpg", "d.json", 9)}
    assert {tuple(r) for r in c.files_sharing_objects(m).collect()} == {("a.jsonl", "b.csv"), ("a.jsonl", "d.json")}
    assert sorted(r.obj for r in c.consolidated(m).collect()) == [f"{P}/1.jpg", f"{P}/2.jpg", f"{P}/4.jpg"]


def test_hot_object_over_several_ranges_is_kept_once(spark):
    rows = [(f"f{i:04d}", line(f"{P}/hot.jpg") + "\n" + line(f"{P}/{i}.jpg")) for i in range(400)]
    m = run(spark, rows, 4_000)
    assert m.count() == 800
    assert m.select("range_no").distinct().count() > 1
    once = c.consolidated(m)
    assert once.count() == 401 and once.select("obj").distinct().count() == 401
    meta = c.range_metadata(m).collect()
    assert sum(r.n_records for r in meta) == 401 and max(r.n_bytes for r in meta) < 4_200
    spans = sorted((r.min_key, r.max_key) for r in meta)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert c.files_sharing_objects(m).count() == 400 * 399 // 2


def test_files_hold_every_object_once(spark, tmp_path):
    # objects whose copies start at and inside range borders
    rows = [(f"f{i:03d}", "\n".join(line(f"{P}/{j:02d}.jpg", 0.25) for j in (i % 40, i % 7, 39))) for i in range(300)]
    meta = c.write_consolidated(c.parse_records(spark.createDataFrame(rows, SCHEMA)), f"file://{tmp_path}/out", 400).collect()
    held = {p.name: [json.loads(x)["aligned_s3_path"] for x in p.read_text().splitlines()] for p in (tmp_path / "out/data").iterdir() if p.suffix == ".jsonl" and p.stat().st_size}
    assert len(held) > 5 and sorted(x for ls in held.values() for x in ls) == [f"{P}/{j:02d}.jpg" for j in range(40)]
    assert {r.out_file: (r.n_records, r.min_key, r.max_key, r.n_bytes) for r in meta} == {n: (len(x), x[0], x[-1], (tmp_path / "out/data" / n).stat().st_size) for n, x in held.items()}
    m = run(spark, rows, 400)
    numbers = {}
    for r in m.collect():
        numbers.setdefault(r.obj, []).append(r.copy_no)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in numbers.values()) and m.count() == 900


def test_empty(spark):
    assert run(spark, []).count() == 0 and c.range_metadata(run(spark, [])).count() == 0


def test_extra_columns_and_a_cut_number(spark):
    df = spark.createDataFrame([("a", f'person_id,aligned_s3_path,det\n1,{P}/1.jpg,1\n1,{P}/2.jpg,0', "x", 1, "y"), (None, f"1,{P}/3.jpg,0.5\n", None, None, None)], "file_key string, body string, obj string, line_no int, head string")
    m = consolidate_rows(df, 1 << 20)
    assert sorted((r.obj, r.file_key) for r in m.collect()) == [(f"{P}/1.jpg", "a"), (f"{P}/3.jpg", None)]
    assert c.files_sharing_objects(m).count() == 0
