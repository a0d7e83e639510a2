"""Parts put together and images chosen, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from vetspan.functions import text
from vetspan.operators import assembly

PARTS = "id long, position long, text string, visible string, stripped string, concealed boolean, links array<string>, image_refs array<string>, images int"


def test_parts_with_nulls_ties_and_other_columns(spark):
    rows = [
        (1, 2, "b", "v", None, True, None, ["<X%41>", "xa", "x" * 2049], 0), (1, 1, "a", "a", None, None, ["http://h.example/1", "no link"], None, 0), (1, 1, "a", "a", None, None, ["http://h.example/1"], None, 0),
        (1, 3, "  ", "w", "s", False, None, None, None), (1, 4, None, None, None, None, None, None, 2), (2, 1, None, None, None, None, None, None, None), (3, None, "x", None, "", False, ["http://h.example/2"], ["", None], 0),
    ]
    table = spark.createDataFrame(rows, PARTS).withColumn("parts", F.lit("mine"))
    got = {r.id: r for r in assembly.assemble(table).collect()}
    assert got[1].text == "a\n\na\n\nb\n\n" and got[1].visible == "a\n\na\n\nv\n\n" and got[1].stripped == "a\n\na" and got[1].concealed
    assert got[1].links == ["http://h.example/1"] and got[1].image_refs == ["xa"]
    assert (got[2].text, got[2].stripped, got[2].links) == ("", "", []) and got[3].stripped == "x"
    assert assembly.assemble(table.limit(0)).count() == 0


def test_references_are_capped(spark):
    got = spark.range(1).select(assembly.capped_references(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("r"), i.cast("string")))).alias("r")).first().r
    assert got == [f"r{i}" for i in range(1, 101)]


@pytest.mark.parametrize("options", [
    assembly.ImageOptions("always", 0, 3, 50, 900), assembly.ImageOptions("fallback", 5, 2, 50, 900), assembly.ImageOptions("always", 0, 4, 60, 2000, 100, 2500), assembly.ImageOptions("always", 0, 0, 50, 900), assembly.ImageOptions("off")
])
def test_images_against_a_plain_loop(spark, options):
    rng = random.Random(options.max_bytes + options.max_images)
    contents = [(i, [f"c{rng.randint(0, 5)}" for _ in range(rng.randint(0, 3))], rng.randint(0, 9)) for i in range(60)]
    images = [(rng.randint(0, 65), k, rng.choice([None, "", "<C1>", "c2", "C%33", "c9"]), rng.choice([None, "image/png", "image/gif", "image/webp"]), rng.choice([None, 10, 40, 50, 51]), rng.choice([0, 10, 30, None]), rng.choice([10, 30, 31])) for k in range(600)]
    expected = {}
    for id_, refs, confident in contents:
        chosen, omitted, size, pixels = [], 0, 0, 0
        own = [x for x in images if x[0] == id_]
        ids = {None: "", "": "", "<C1>": "c1", "c2": "c2", "C%33": "c3", "c9": "c9"}
        for want in (True, False):
            for _, k, cid, kind, n, w, h in sorted(own, key=lambda x: x[1]):
                if (ids[cid] != "" and ids[cid] in refs) != want:
                    continue
                fits = kind in ("image/png", "image/gif") and n is not None and n <= options.max_bytes and w and w * h <= options.max_pixels and len(chosen) < options.max_images
                fits = fits and (options.total_bytes is None or size + n <= options.total_bytes) and (options.total_pixels is None or pixels + w * h <= options.total_pixels)
                if fits:
                    chosen, size, pixels = [*chosen, k], size + n, pixels + w * h
                else:
                    omitted += 1
        if options.mode == "off" or (options.mode == "fallback" and confident >= options.min_text_characters):
            chosen, omitted = [], 0
        expected[id_] = (chosen, omitted)
    got = assembly.choose_images(spark.createDataFrame(contents, "id int, image_refs array<string>, confident int"), spark.createDataFrame(images, "id int, position int, content_id string, media_type string, bytes int, width int, height int"), options)
    assert {r.id: (r.chosen, r.omitted) for r in got.collect()} == expected


def test_lines_are_trimmed_of_spaces_only(spark):
    got = spark.createDataFrame([(" 00 \r\n1 x1\n\n 22",)], "t string").select(text.lines(F.col("t")).alias("x")).first().x
    assert got == ["00", "1 x1", "22"]
