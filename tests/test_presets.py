"""Templates against the reference's rules, on small spines."""

import json

from leafwise.operators import presets
from tests.conftest import rows_of
from tests.test_layout import entries, page, table

FILES = "path string, width long, height long"


def parsed(spark, templates):
    rows = [(key, json.dumps(t)) for key, t in templates.items()]
    return presets.parse_presets(spark.createDataFrame(rows, "preset_id long, json string"))


def template(*items, version=2, **more):
    return {"version": version, "source_page_count": 3, "entries": list(items), **more}


def test_no_volume_is_lost_and_errors_are_named(spark):
    source, lost = {"kind": "source", "source_index": 2}, {"kind": "inserted", "path": "/lost.png"}
    texts = parsed(
        spark,
        {
            1: template(source),
            2: template(source, lost, {"kind": "odd"}),
            3: template({"kind": "odd"}, lost),
            4: template({"kind": "inserted", "path": "/a.gif"}),
            5: template({"source_index": 1}),
            6: template({"kind": "inserted", "path": "/a.JPEG"}, source),
            7: template(source, version=3),
        },
    )
    layout = [page(1), page(2), page(3), page(4)]
    spine = table(spark, {v: layout for v in range(10)})
    targets = spark.createDataFrame([(v, v) for v in range(1, 9)], "volume_id long, preset_id long")
    files = spark.createDataFrame([("/a.gif", 5, 6), ("/a.JPEG", 7, 8)], FILES)
    spines, errors = presets.apply_preset_v2(spine, targets, texts, files)
    got = entries(spines)
    image = ("inserted", None, "inserted-0001", "/a.JPEG", 7, 8, "jpg")
    assert got == {v: layout for v in range(10)} | {1: [page(2), page(4)], 6: [image, page(2), page(4)]}
    assert dict(rows_of(errors)) == {
        2: "Inserted image not found: /lost.png",
        3: "Unsupported preset entry kind: odd",
        4: "Only JPEG and PNG images can be inserted",
        5: "Unsupported preset entry kind: None",
        7: "Unsupported preset version",
        8: "Preset not found",
    }


def test_templates_are_applied_to_the_volumes_in_scope(spark):
    source, lost = {"kind": "source", "source_index": 2}, {"kind": "inserted", "path": "/lost.png"}
    texts = parsed(
        spark, {1: template(source), 2: template(lost), 3: {"version": 1, "deleted_source_pages": [1], "blank_positions": [1]}}
    )
    layout = [page(1), page(2), page(3), page(4)]
    spine = table(spark, {v: layout for v in range(1, 7)})
    volumes = spark.createDataFrame(
        [(s, 2 * s + n - 2, "T", n, "Ready") for s in (1, 2, 3) for n in (1, 2)],
        "series_id long, volume_id long, title string, volume_number long, status string",
    )
    scopes = spark.createDataFrame([(1, "2"), (2, "all"), (3, "1")], "series_id long, scope string")
    preset_of = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "series_id long, preset_id long")
    spines, after, errors = presets.apply_preset_to_scope(
        volumes, scopes, preset_of, spine, texts, spark.createDataFrame([], FILES)
    )
    blank = ("blank", None, None, None, 102, 202, None)
    got = entries(spines)
    assert got == {v: layout for v in range(1, 7)} | {2: [page(2), page(4)], 5: [page(2), blank, page(3), page(4)]}
    assert dict(rows_of(after.select("volume_id", "status"))) == {v: "Edited" if v in (2, 5) else "Ready" for v in range(1, 7)}
    assert dict(rows_of(errors)) == {v: "Inserted image not found: /lost.png" for v in (3, 4)}


def test_images_are_numbered_once_a_template(spark):
    """A path that all templates share meets its file once a template, not once a volume."""
    shared = [{"kind": "inserted", "path": "/a.png"}, {"kind": "inserted", "path": "/a.png", "entry_id": "inserted-0007"}]
    texts = parsed(spark, {k: template(*shared, shared[0], {"kind": "source", "source_index": 1}) for k in (1, 2)})
    images = presets._template_images(presets.preset_entries(texts))
    assert sorted(rows_of(images.select("preset_id", "_pos", "item_id"))) == [
        (k, p, f"inserted-{n:04d}") for k in (1, 2) for p, n in ((0, 1), (1, 7), (2, 8))
    ]
    spine = table(spark, {v: [page(1), page(2)] for v in range(40)})
    targets = spark.createDataFrame([(v, v % 2 + 1) for v in range(40)], "volume_id long, preset_id long")
    spines, errors = presets.apply_preset_v2(spine, targets, texts, spark.createDataFrame([("/a.png", 5, 6)], FILES))
    assert errors.count() == 0
    got = spines.where("kind = 'inserted'").groupBy("item_id", "width").count()
    assert sorted(rows_of(got)) == [(f"inserted-{n:04d}", 5, 40) for n in (1, 7, 8)]
