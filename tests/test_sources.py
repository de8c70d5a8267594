"""Archives, CSV and JSON files, and event streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from leafwise.functions import names, paths
from leafwise.operators import package, presets
from leafwise.operators import spine as ops
from leafwise.sources import archives, documents, files, tables
from tests.conftest import rows_of
from leafwise.streaming import events, state


def test_archive_members_by_entry(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.cbz", "w") as z:
        z.writestr("art/10.jpg", b"x")
        z.writestr("art/2.jpg", b"yy")
        with pytest.warns(UserWarning):
            z.writestr("art/2.jpg", b"zzz")
        z.writestr("__MACOSX/2.jpg", b"")
        z.writestr("art/.hidden.png", b"")
        z.writestr("notes.txt", b"")
        z.mkdir("empty")
    (tmp_path / "b.zip").write_bytes(b"not a zip")
    members = archives.scan_archives(spark, str(tmp_path))
    kept = members.where(names.is_image_member(F.col("member_name"), F.col("is_dir")))
    assert [(r.member_name, r.size) for r in kept.orderBy("member_ordinal").collect()] == [
        ("art/10.jpg", 1), ("art/2.jpg", 2), ("art/2.jpg", 3),
    ]
    errors = [r.error for r in members.where("error IS NOT NULL").collect()]
    assert len(errors) == 1 and errors[0].startswith("Cannot read archive source: ")


def test_archives_that_cannot_be_read_are_rows(spark, tmp_path):
    """Vanished, empty and cut archives, one without members, a folder under an archive's name, and a path that was never there."""
    with zipfile.ZipFile(tmp_path / "good.ZIP", "w") as z:
        z.writestr("1.jpg", b"x")
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    whole = (tmp_path / "good.ZIP").read_bytes()
    (tmp_path / "cut.cbz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "empty.cbz").write_bytes(b"")
    (tmp_path / "folder.cbz").mkdir()
    names_ = ["good.ZIP", "none.zip", "cut.cbz", "empty.cbz", "folder.cbz", "gone.cbz"]
    paths_ = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in names_] + [(None,)], "archive_path string")
    rows = archives.archive_members(paths_).collect()
    short = lambda r: r.archive_path.rsplit("/", 1)[1]
    assert sorted(short(r) for r in rows if r.error) == ["cut.cbz", "empty.cbz", "folder.cbz", "gone.cbz"]
    assert [(short(r), r.member_name) for r in rows if not r.error] == [("good.ZIP", "1.jpg")]
    scanned = archives.scan_archives(spark, str(tmp_path)).collect()
    assert sorted(short(r) for r in scanned if r.error) == ["cut.cbz", "empty.cbz"]
    (row,) = archives.scan_archives(spark, str(tmp_path / "never")).collect()
    assert row.error == f"Cannot read archive source: {tmp_path}/never"
    (tmp_path / "bare").mkdir()
    assert archives.scan_archives(spark, str(tmp_path / "bare")).count() == 0


def test_a_filter_on_the_path_leaves_other_archives_unopened(spark, tmp_path):
    for n in range(3):
        with zipfile.ZipFile(tmp_path / f"{n}.cbz", "w") as z:
            z.writestr(f"{n}.jpg", b"x")
    reader = archives.PruningReader(str(tmp_path))
    list(reader.pushFilters([archives.In(("archive_path",), (f"{tmp_path}/1.cbz", f"{tmp_path}/2.cbz"))]))
    list(reader.pushFilters([archives.EqualTo(("archive_path",), f"{tmp_path}/1.cbz")]))
    assert [lot.paths for lot in reader.partitions()] == [[f"{tmp_path}/1.cbz"]]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = archives.scan_archives(spark, str(tmp_path)).where(F.col("archive_path") == f"{tmp_path}/2.cbz")
        assert [r.member_name for r in rows.collect()] == ["2.jpg"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_written_archives_are_listed_as_they_were(spark, tmp_path):
    rows = [("a/b", 2, "y.png", b"22"), ("a/b", 1, "x.png", b"1"), ("a/b", 2, "y.png", b"333"), ("c", 1, "z.png", None), (None, 1, None, b"")]
    members = spark.createDataFrame(rows, "archive string, position long, name string, content binary")
    written = archives.write_archives(members, str(tmp_path / "out"))
    assert sorted((r.archive, r.members) for r in written.collect()) == [(archives.UNNAMED, 1), ("a/b", 3), ("c", 1)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{archives.UNNAMED}.cbz", "a%2Fb.cbz", "c.cbz"]
    got = [(r.member_name, r.size) for r in archives.scan_archives(spark, str(tmp_path / "out" / "a%2Fb.cbz")).orderBy("member_ordinal").collect()]
    assert got[0] == ("x.png", 1) and sorted(got[1:]) == [("y.png", 2), ("y.png", 3)]
    assert archives.write_archives(members.limit(0), str(tmp_path / "no")).count() == 0
    uri = f"file:{tmp_path}/uri"  # names inside a URI are encoded once more, and found again
    archives.write_archives(members, uri).collect()
    assert sorted(p.name for p in (tmp_path / "uri").iterdir()) == [f"{archives.UNNAMED}.cbz", "a%2Fb.cbz", "c.cbz"]
    scanned = archives.scan_archives(spark, uri).where("error IS NULL")
    assert sorted(r.size for r in archives.archive_members(scanned.select("archive_path").distinct()).collect()) == [0, 0, 1, 2, 3]


def test_folder_images_in_natural_order(spark, tmp_path):
    for name in ("p10.png", "P2.jpg", "p1.webp", "skip.txt"):
        (tmp_path / name).write_bytes(b"x")
    rows = files.list_image_files(spark, str(tmp_path)).orderBy("position").collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["p1.webp", "P2.jpg", "p10.png"]


def test_insert_candidates_csv(spark, tmp_path):
    (tmp_path / "v1.csv").write_text(
        "gap,after_page,before_page,safe_insert_score,label,visual_difference,continuity_risk,reasons\n"
        "999-999,7,8,0.5,B low_content_pause,0.1,0.2,low content; ;  title-like page ;\n"
    )
    (row,) = tables.read_insert_candidates(spark, str(tmp_path / "v1.csv")).collect()
    assert (row.volume, row.gap_id, row.reasons) == ("v1", "007-008", ["low content", "title-like page"])


def test_missing_csv_columns_are_listed_in_order(spark, tmp_path):
    (tmp_path / "c.csv").write_text("start_page,spread\n1,0.5\n")
    with pytest.raises(ValueError, match="c.csv is missing required columns: decision, end_page, review_score"):
        tables.read_spread_candidates(spark, str(tmp_path / "c.csv"))


def test_every_csv_file_has_a_header_of_its_own(spark, tmp_path):
    """Files that order their columns differently, quote them, add others or start with a mark are read by name."""
    files = {
        "a": "start_page,end_page,decision,spread,review_score\n1,2,auto,0.1,0.9\n",
        "b": "review_score,spread,note,decision,end_page,start_page\n0.8,0.2,x,review,4,3\n\n0.7,0.3,\"a, b\",auto,6,5\n",
        "c d+e": '\ufeff"spread","start_page","end_page","decision","review_score"\r\n0.4,7,8,auto,0.6\r\n',
        "e": "start_page,end_page,decision,spread,review_score\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    got = tables.read_spread_candidates(spark, str(tmp_path)).select("volume", "start_page", "score", "review_score", "decision")
    assert sorted(rows_of(got)) == [
        ("a", 1, 0.1, 0.9, "auto"), ("b", 3, 0.2, 0.8, "review"), ("b", 5, 0.3, 0.7, "auto"), ("c d+e", 7, 0.4, 0.6, "auto"),
    ]
    (tmp_path / "f.csv").write_text("start_page,spread\n1,0.5\n")
    (tmp_path / "g.csv").write_text("end_page,start_page,decision,spread\n")
    with pytest.raises(ValueError, match="f.csv is missing .*: decision, end_page, review_score; g.csv is missing .*: review_score$"):
        tables.read_spread_candidates(spark, str(tmp_path))
    assert tables.files_without_columns(spark, str(tmp_path), tables.SPREAD_COLUMNS).count() == 2


def test_written_tables_come_back(spark, tmp_path):
    """Volume names with marks, null values, and a volume whose rows stand in several files."""
    rows = [(v, n, 100, 90, *[0.5 if k else None for k in range(len(tables.RATIOS))]) for v in ("a+b/c d", "007", None) for n in range(40)]
    schema = "volume_id string, page long, width long, height long, " + ", ".join(f"{r} double" for r in tables.RATIOS)
    features = spark.createDataFrame(rows, schema)
    tables.write_features(features, str(tmp_path / "out"))
    got = tables.read_table(spark, str(tmp_path / "out"), tables.FEATURE_FIELDS)
    key = lambda r: (str(r[0]), r[1])
    assert sorted(rows_of(got), key=key) == sorted(rows, key=key)


def test_gap_files_round_trip(spark, tmp_path):
    gap = spark.createDataFrame(
        [("v", 1, 2, 0.1234567, "A chapter_boundary", 0.5, 0.25, ["a", "b"])],
        "volume_id string, gap_after_page long, gap_before_page long, safe_insert_score double, label string, "
        "visual_difference double, continuity_risk double, reasons array<string>",
    )
    tables.write_gaps(gap, str(tmp_path / "out"))
    (part,) = (tmp_path / "out" / "volume_id=v").glob("*.csv")
    assert part.read_text().splitlines()[1] == "001-002,1,2,0.123457,A chapter_boundary,0.500000,0.250000,a; b"
    (row,) = tables.read_insert_candidates(spark, str(part)).collect()
    assert row.safe_insert_score == 0.123457


def test_presets_round_trip(spark, tmp_path):
    spine = spark.createDataFrame(
        [(5, 0, "blank", None, None, None), (5, 1, "source", 3, "page-0003", None), (5, 2, "inserted", None, "inserted-0001", "/a.png")],
        "volume_id long, entry_index long, kind string, source_index long, item_id string, inserted_path string",
    )
    meta = spark.createDataFrame(
        [(5, 3, 'A "quoted" title', "", "en", True, "source", 3, None)],
        "volume_id long, source_page_count long, title string, author string, language string, exclude_cover boolean, "
        "cover_kind string, cover_source_index long, cover_entry_id string",
    )
    lines = documents.preset_document_lines(meta, ops.extract_entries(spine))
    documents.write_documents(lines, "volume_id", str(tmp_path / "out"))
    (part,) = (tmp_path / "out" / "volume_id=5").glob("*.txt")
    payload = json.loads(part.read_text())
    assert payload["metadata"]["title"] == 'A "quoted" title' and payload["cover"]["source_index"] == 3
    assert payload["entries"][0] == {"kind": "blank"}
    back = documents.read_presets(spark, str(part))
    assert [r.kind for r in presets.preset_entries(back).orderBy("position").collect()] == ["blank", "source", "inserted"]


def test_projects_round_trip(spark, tmp_path):
    project = str(tmp_path / "shelf" / "p.json")
    series = spark.createDataFrame(
        [(1, project, "T", "", "en", None)],
        "series_id long, project_path string, title string, author string, language string, active_volume_number long",
    )
    volumes = spark.createDataFrame(
        [(1, 1, str(tmp_path / "in" / "a.cbz"), 4, "Ready", None, ["w"], None)],
        "series_id long, position long, path string, volume_number long, status string, output_path string, "
        "warnings array<string>, error string",
    ).withColumn("layout", F.lit(None).cast(presets.PRESET_TYPE))
    lines = documents.project_document_lines(series, volumes)
    documents.write_documents(lines, "series_id", str(tmp_path / "out"))
    (part,) = (tmp_path / "out" / "series_id=1").glob("*.txt")
    payload = json.loads(part.read_text())
    assert payload["volumes"][0]["pdf_path"] == "../in/a.cbz" and payload["volumes"][0]["layout"] is None
    parsed = documents.parse_projects(spark.createDataFrame([(project, part.read_text())], "path string, json string"))
    (row,) = documents.project_volumes(parsed).collect()
    assert (row.path, row.volume_number, row.status) == (str(tmp_path / "in" / "a.cbz"), 4, "Ready")


def test_many_documents_are_written_and_read_by_many_tasks(spark, tmp_path):
    parts = [(k, p, 1, f"{k}-{p}" if k != 3 else None) for k in [*range(40), None] for p in (2, 0, 1)]
    lines = spark.createDataFrame(parts, "book string, position long, part int, value string")
    folder = str(tmp_path / "out")
    files = documents.write_documents(lines, "book", folder)
    assert files.count() == 41 and {len(list(f.iterdir())) for f in (tmp_path / "out").iterdir()} == {1}
    read = documents.documents_at(files)
    assert read.rdd.getNumPartitions() >= 4
    found = {r.book: r.json for r in read.collect()}
    want = {k: "".join(f"{k}-{p}\n" for p in range(3)) for k in [str(i) for i in range(40)]}
    assert found == {**want, "3": "\n\n\n", None: "None-0\nNone-1\nNone-2\n"}
    with pytest.raises(FileExistsError):
        documents.write_documents(lines, "book", folder)


@pytest.mark.parametrize(
    ("path", "want"),
    [("a/../b", "b"), ("../a/./b//c", "../a/b/c"), ("/../x", "/x"), ("", "."), ("a/..", "."), ("../../x/..", "../..")],
)
def test_normalized_paths(spark, path, want):
    assert spark.range(1).select(paths.normalize_path(F.lit(path))).first()[0] == want


@pytest.mark.parametrize(
    ("stem", "title", "author", "number"),
    [
        ("[黎明][作者] Vol.07", "黎明", "作者", 7),
        ("長い題、上 作者 vol 3", "長い題、上", "作者", 3),
        ("Plain Story Volume 12", "Plain Story", "", 12),
        ("story 08", "story 08", "", 8),
        ("nothing", "nothing", "", 99),
    ],
)
def test_series_inference(spark, stem, title, author, number):
    t, a = names.series_title_author(F.lit(stem))
    row = spark.range(1).select(t, a, names.volume_number(F.lit(stem), F.lit(99).cast("bigint"))).first()
    assert tuple(row) == (title, author, number)


def test_image_references_are_resolved(spark):
    text = '<svg><image width="1" xlink:href="../images/a.png"/><image href=\'data:x\'/><image href="b.png"/></svg>'
    df = spark.createDataFrame([(1, "p", "EPUB/xhtml/p.xhtml", text)], "book_id long, item_id string, page_path string, text string")
    assert sorted(r.path for r in package.extract_refs(df, package.IMAGE_REF).collect()) == ["EPUB/images/a.png", "EPUB/xhtml/b.png"]


def test_progress_stream(spark, tmp_path):
    lines = ['MTE_PROGRESS {"completed": 3, "total": 2, "message": "m"}', "MTE_PROGRESS {broken", "plain", "MTE_PROGRESS {}"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.txt").write_text("\n".join(lines) + "\n")
    stream = events.read_lines(spark, str(tmp_path / "in"))
    found = events.progress_events(stream).select("job", F.lit(1).alias("seq"), "event.*")
    query = state.upsert_state(events.progress_latest(found), ["job"], str(tmp_path / "state"), str(tmp_path / "cp"))
    query.awaitTermination()
    (row,) = state.current_state(spark, ["job"], str(tmp_path / "state")).collect()
    assert (row.completed, row.total, row.message) == (2, 2, "m")
    static = spark.read.text(str(tmp_path / "in"))
    assert sorted(r.value for r in events.log_lines(static).collect()) == ["MTE_PROGRESS {broken", "plain"]


def test_state_survives_a_second_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "volume_id long, pair_id string, status string, seq long"

    def arrive(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("volume_id", "pair_id", "status", "seq"), r, strict=True))) for r in rows))
        marks = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        run = state.upsert_state(events.review_state(marks), ["volume_id", "pair_id"], str(tmp_path / "state"), str(tmp_path / "cp"))
        run.awaitTermination()
        rows = state.current_state(spark, ["volume_id", "pair_id"], str(tmp_path / "state"))
        return {(r.volume_id, r.pair_id): r.status for r in rows.collect()}

    assert arrive("a.json", [(1, "001-002", "true", 5), (1, "003-004", "maybe", 6)]) == {(1, "001-002"): "true"}
    assert arrive("b.json", [(1, "001-002", "false", 4), (2, "001-002", "false", 7)]) == {
        (1, "001-002"): "true", (2, "001-002"): "false",
    }


def test_state_files_stay_bounded_over_many_batches(spark, tmp_path):
    """Two runs of many micro-batches: few folders, the newest state, and a half-written base that is not read."""
    (tmp_path / "in").mkdir()
    keys, root = ["volume_id", "pair_id"], tmp_path / "state"
    want = {}

    def arrive(numbers):
        for n in numbers:
            marks = [(n % 3, f"p{n % 2}", "true" if n % 5 else "false", n), (100 + n, "p", "pending", n)]
            want.update({(v, p): s for v, p, s, _ in marks})
            text = [json.dumps({"volume_id": v, "pair_id": p, "status": s, "seq": q}) for v, p, s, q in marks]
            (tmp_path / "in" / f"{n:03}.json").write_text("\n".join(text))
        stream = spark.readStream.option("maxFilesPerTrigger", 1)
        marks = stream.schema("volume_id long, pair_id string, status string, seq long").json(str(tmp_path / "in"))
        state.upsert_state(events.review_state(marks), keys, str(root), str(tmp_path / "cp"), merge_every=3).awaitTermination()
        return {(r.volume_id, r.pair_id): r.status for r in state.current_state(spark, keys, str(root)).collect()}

    assert arrive(range(7)) == want
    (root / "base=99").mkdir()  # a merge that did not end
    assert arrive(range(7, 14)) == want
    assert len([p for p in root.iterdir() if p.name != "base=99"]) <= 2 + 2 * 3
    assert arrive([]) == want


def test_a_repeated_merge_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "state")
    schema = "k long, v string, _epoch int"
    for epoch in range(6):
        spark.createDataFrame([(epoch % 2, f"v{epoch}", epoch)], schema).write.parquet(f"{folder}/delta={epoch}")
        if epoch in (1, 3, 5):
            for _ in range(2):
                state.merge_state(spark, ["k"], folder, epoch)
                rows = state.current_state(spark, ["k"], folder).collect()
                assert {r.k: r.v for r in rows} == {epoch % 2: f"v{epoch}", (epoch + 1) % 2: f"v{epoch - 1}"}
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["base=3", "base=5", "delta=4", "delta=5"]
    with pytest.raises(ValueError, match="no state under"):
        state.current_state(spark, ["k"], str(tmp_path / "none"))
