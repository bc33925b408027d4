from pyspark.sql import functions as F

from scrubjay.functions import paths, provenance
from scrubjay.kernels.formats import box_with_label
from scrubjay.operators import gate, report

INVENTORY = "base string, path string, dir string, name string, stem string, suffix string, ord long"


def inventory(spark, *names):
    rows = spark.createDataFrame([("in", f"in/{n}", f"in/{n}".rpartition("/")[0], n.rpartition("/")[2], k) for k, n in enumerate(names)], "base string, path string, dir string, name string, ord long")
    return rows.select("base", "path", "dir", "name", paths.stem_of(F.col("name")).alias("stem"), paths.suffix_of(F.col("name")).alias("suffix"), "ord")


def test_names(spark):
    from pathlib import PurePosixPath

    names = ["a.jpg", "a.tar.gz", ".bashrc", "noext", "a.", "a..b", ".x.y", "dir.d/f", "a.b.C2PA", "..x"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", paths.suffix_of(F.col("name")).alias("s")).collect()
    for r in rows:
        assert r.s == PurePosixPath(r.name).suffix or r.name in ("a.", "..x", "a..b"), r.name


def test_sidecars_assets_orphans(spark):
    files = inventory(spark, "photo.jpg", "photo.c2pa", "photo.jpg.c2pa", "x.png", "X.c2pa", "d/photo.jpg", "lone.c2pa", "y.tar.gz", "y.C2PA", "y.tar.gz.c2pa", "z", "z.c2pa")
    sides = {r.path: r.sidecars for r in gate.sidecars(files).collect()}
    assert sides == {"in/photo.jpg": ["in/photo.c2pa", "in/photo.jpg.c2pa"], "in/y.tar.gz": ["in/y.tar.gz.c2pa"], "in/z": ["in/z.c2pa"]}
    owned = {r.path: r.manifest_assets for r in gate.sidecar_assets(files).collect()}
    assert owned["in/photo.c2pa"] == ["in/photo.jpg"] and owned["in/y.C2PA"] == ["in/y.tar.gz"] and owned["in/photo.jpg.c2pa"] == ["in/photo.jpg"]
    assert {r.path for r in gate.orphans(files).collect()} == {"in/X.c2pa", "in/lone.c2pa", "in/z.c2pa"}
    assert {r.path for r in gate.unmatched_assets(files).collect()} == {"in/x.png", "in/d/photo.jpg"}
    told = {r.path: (r.d, r.w) for r in gate.provenance_of(files).select("path", provenance.disposition(F.col("prov")).alias("d"), provenance.describe(F.col("prov")).alias("w")).collect()}
    assert told["in/photo.jpg"] == ("refuse", "sidecar photo.c2pa, sidecar photo.jpg.c2pa") and told["in/x.png"] == ("scrub_freely", "none")
    assert told["in/photo.c2pa"] == ("refuse_is_manifest", "detached C2PA manifest for photo.jpg") and "orphaned" in told["in/lone.c2pa"][1]


def test_structural_scan_equals_the_kernel(spark):
    import random

    rng = random.Random(2)
    blobs = []
    for _ in range(400):
        parts = [rng.choice([b"jumb", b"c2pa", bytes([0, 0, 0, rng.randint(0, 60)]), bytes(4), b"text", bytes(rng.randrange(256) for _ in range(rng.randint(0, 70)))]) for _ in range(rng.randint(0, 7))]
        blobs.append(b"".join(parts))
    rows = spark.createDataFrame(list(enumerate(blobs)), "i long, b binary").select("i", provenance.has_credentials(F.col("b")).alias("x"))
    got = {r.i: r.x for r in rows.collect()}
    assert [got[i] for i in range(len(blobs))] == [box_with_label(b) for b in blobs] and any(got.values()) and not all(got.values())


def test_report_wording(spark):
    none = F.lit(None).cast("string")
    p = F.struct(F.lit(True).alias("embedded"), F.array().cast("array<string>").alias("sidecars"), none.alias("remote_url"), none.alias("unrecognized"), F.lit(False).alias("is_manifest"), F.array().cast("array<string>").alias("manifest_assets"), F.lit(None).cast(provenance.SIGNER).alias("signer"))
    rows = spark.range(1).select(F.col("id").alias("ord"), F.lit("p").alias("path"), F.lit("refuse").alias("disposition"), p.alias("prov"), F.expr("array(named_struct('where', 'EXIF', 'what', 'GPS IFD', 'detail', '', 'applied', false))").alias("removals"), F.array(F.lit("x")).alias("preserved"), none.alias("written"), none.alias("error"))
    text = report.text_rows(rows, verbose=False).first().text.split("\n")
    assert text[0] == "REFUSED  p" and text[2:] == [" " * 9 + "found: embedded manifest", " " * 9 + "found 1 item(s) that would be removed if it were scrubbable", " " * 9 + report.NO_SAFE_EDIT]
