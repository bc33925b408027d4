import json
import os
import stat

from scrubjay.cli import main, parser
from scrubjay.kernels.base import Policy
from scrubjay.operators.scrub import scrub_rows
from scrubjay.plans import run, samples
from scrubjay.sources import files, stores


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in sorted(folder.rglob("*")) if p.is_file()}


def staged(tmp_path):
    src = tmp_path / "src"
    (src / "a").mkdir(parents=True)
    (src / "b").mkdir()
    (src / "photo.jpg").write_bytes(samples.jpeg(12))
    (src / "signed.jpg").write_bytes(samples.credentials(1))
    (src / "remote.jpg").write_bytes(samples.credentials(2))
    (src / "cut.jpg").write_bytes(samples.credentials(3))
    (src / "side.png").write_bytes(samples.png(2))
    (src / "side.C2PA").write_bytes(b"manifest")
    (src / "lost.c2pa").write_bytes(b"manifest")
    (src / "plain.jpg").write_bytes(b"\xff\xd8\xff\xd9")
    (src / "doc.docx").write_bytes(samples.docx(60))
    (src / "report.pdf").write_bytes(b"%PDF-1.4 x")
    (src / "_hidden.tex").write_bytes(b"\\documentclass{a}\n\\author{Ann}% x\n")
    for d in "ab":
        (src / d / "intro.tex").write_bytes(b"\\author{" + d.encode() + b"nn}\n")
    (src / "notes.txt").write_bytes(b"\\documentclass{a}")
    return src


def by_name(rows, src):
    return {os.path.relpath(r.path, src): r for r in rows.collect()}


def test_inspect_reports_and_writes_nothing(spark, tmp_path):
    src = staged(tmp_path)
    before = tree(src)
    rows = by_name(run.inspect(spark, [str(src)], recursive=True), src)
    assert tree(src) == before and "notes.txt" not in rows and len(rows) == 13
    kinds = {n: r.disposition for n, r in rows.items()}
    assert kinds["signed.jpg"] == kinds["remote.jpg"] == kinds["side.png"] == "refuse" and kinds["cut.jpg"] == "refuse_unrecognized"
    assert kinds["side.C2PA"] == kinds["lost.c2pa"] == "refuse_is_manifest" and kinds["photo.jpg"] == kinds["_hidden.tex"] == "scrub_freely"
    assert rows["signed.jpg"].removals == [] or not any(r.applied for r in rows["signed.jpg"].removals)
    assert [r for r in rows["side.png"].removals] and not any(r.applied for r in rows["side.png"].removals)
    assert any(r.applied for r in rows["photo.jpg"].removals) and "unsupported" in rows["report.pdf"].error
    text = run.report_text(run.inspect(spark, [str(src / "photo.jpg"), str(src / "signed.jpg"), str(tmp_path / "none")]))
    assert "would remove: EXIF: GPS IFD" in text and text.endswith("3 file(s), 2 refused, 1 processed")


def test_scrub_writes_only_what_may_be(spark, tmp_path):
    src, out = staged(tmp_path), tmp_path / "out"
    before = tree(src)
    rows = by_name(run.scrub(spark, [str(src)], recursive=True, output_dir=str(out)), src)
    assert tree(src) == before
    assert set(tree(out)) == {"photo.jpg", "doc.docx", "_hidden.tex", "a/intro.tex", "b/intro.tex"}
    assert b"Annie" not in tree(out)["photo.jpg"] and rows["photo.jpg"].written == str(out / "photo.jpg") and rows["signed.jpg"].written is None


def test_default_names_collisions_and_in_place(spark, tmp_path):
    src = tmp_path / "s"
    src.mkdir()
    file = src / "a.tex"
    file.write_bytes(b"\\author{Ann}\n")
    os.chmod(file, 0o640)
    rows = run.scrub(spark, [str(file), str(file)]).orderBy("ord").collect()
    assert rows[0].written == str(src / "a.cleaned.tex") and "already claimed" in rows[1].error
    assert (src / "a.cleaned.tex").read_bytes() == b"\\author{}\n" and file.read_bytes() == b"\\author{Ann}\n"
    link = src / "link.tex"
    link.symlink_to(file)
    run.scrub(spark, [str(link)], in_place=True).collect()
    assert link.is_symlink() and file.read_bytes() == b"\\author{}\n" and stat.S_IMODE(file.stat().st_mode) == 0o640
    assert [r.written for r in run.scrub(spark, [str(file)], in_place=True).collect()] == [None]
    run.scrub(spark, [str(file)], destination=str(src / "saved.tex")).collect()
    assert (src / "saved.tex").read_bytes() == file.read_bytes()


def test_atomic_write_leaves_nothing_behind(tmp_path, monkeypatch):
    target = tmp_path / "x"
    target.write_bytes(b"old")
    monkeypatch.setattr(files.os, "replace", lambda *a: (_ for _ in ()).throw(OSError("full")))
    try:
        files.atomic_write(str(target), b"new")
    except OSError:
        pass
    assert target.read_bytes() == b"old" and len(list(tmp_path.iterdir())) == 1


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    src = staged(tmp_path)
    monkeypatch.setattr("scrubjay.session.local_session", lambda: spark)
    assert main(["inspect", "--json", str(src / "photo.jpg"), str(src / "signed.jpg")]) == 1
    shown = json.loads(capsys.readouterr().out)
    assert len(shown) == 2 and list(shown[0]) == ["path", "disposition", "refused", "reason", "provenance", "attribution", "signer", "sidecars", "removals", "found", "preserved", "written"]
    assert main(["scrub", str(src / "photo.jpg")]) == 0 and (src / "photo.cleaned.jpg").exists()
    assert main(["scrub", "--reseal", str(src / "photo.jpg")]) == 2
    note, bad = tmp_path / "n.txt", tmp_path / "bad.txt"
    note.write_bytes("a\u200bb\n".encode())
    bad.write_bytes(b"\xff")
    capsys.readouterr()
    assert main(["text", "--in-place", "--report", str(note), str(bad)]) == 1 and note.read_bytes() == b"ab\n"
    said = capsys.readouterr().err
    assert "1 change(s)" in said and "ZERO WIDTH SPACE" in said and "not valid utf-8" in said
    assert parser().parse_args(["text", "--normalize", "nfc"]).paths == []


def test_dates_by_policy(spark, tmp_path):
    file = tmp_path / "d.tex"
    file.write_bytes(b"\\date{2024}\n")
    assert run.inspect(spark, [str(file)]).first().removals == []
    assert [r.where for r in run.inspect(spark, [str(file)], Policy(strip_dates=True)).first().removals] == ["\\date"]


def test_addresses_give_what_paths_give(spark, tmp_path):
    src, out = staged(tmp_path), tmp_path / "out"
    (src / "a" / "odd name#%20.tex").write_bytes(b"\\author{Ann}\n")
    at = f"file://{src}"
    before = tree(src)
    local, far = ({r.path.removeprefix("file://"): r.asDict(True) for r in run.inspect(spark, [p], recursive=True).collect()} for p in (str(src), at))
    plain = lambda r: {k: str(v).replace("file://", "") for k, v in r.items()}
    assert {k: plain(r) for k, r in local.items()} == {k: plain(r) for k, r in far.items()} and len(far) == 14
    rows = {r.path: r for r in run.scrub(spark, [at], recursive=True, output_dir=f"file://{out}").collect()}
    assert tree(src) == before and set(tree(out)) == {"photo.jpg", "doc.docx", "_hidden.tex", "a/intro.tex", "a/odd name#%20.tex", "b/intro.tex"}
    assert rows[f"{at}/photo.jpg"].written == f"file://{out}/photo.jpg" and rows[f"{at}/signed.jpg"].written is None
    assert run.inspect(spark, [f"{at}/none.tex"]).first().error == "no such file or directory"
    assert run.inspect(spark, [f"{at}/a"]).count() == 2 and run.inspect(spark, [f"{at}/notes.txt"]).count() == 1


def test_addresses_in_place(spark, tmp_path):
    file, link = tmp_path / "a.tex", tmp_path / "link.tex"
    file.write_bytes(b"\\author{Ann}\n")
    os.chmod(file, 0o640)
    link.symlink_to(file)
    run.scrub(spark, [f"file://{link}"], in_place=True).collect()
    assert link.is_symlink() and file.read_bytes() == b"\\author{}\n" and stat.S_IMODE(file.stat().st_mode) == 0o640
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.tex", "link.tex"]


def test_stores_that_do_not_move_over_files(tmp_path, monkeypatch):
    class Strict:
        """A store over a folder that, like some, refuses to move over a file."""

        def __init__(self):
            self.inner = stores.fs.SubTreeFileSystem(str(tmp_path), stores.fs.LocalFileSystem())

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def move(self, a, b):
            if self.inner.get_file_info(b).type != stores.fs.FileType.NotFound:
                raise OSError("exists")
            self.inner.move(a, b)

    monkeypatch.setattr(stores, "opened", lambda prefix: (Strict(), "bucket"))
    for data in (b"old", b"new"):
        files.atomic_write("x://c@host/d/f.tex", data)
        assert stores.read("x://c@host/d/f.tex") == data
    assert [p.name for p in (tmp_path / "bucket" / "d").iterdir()] == ["f.tex"]
    assert list(stores.rooted("x://c@host/d/", False)) == [("x://c@host/d", "x://c@host/d/f.tex", None)] and stores.names("x://c@host/none") == []
    (tmp_path / "bucket" / "d" / "g").mkdir()
    try:
        files.atomic_write("x://c@host/d/g", b"data")
        raise AssertionError("written over a folder")
    except OSError:
        assert sorted(p.name for p in (tmp_path / "bucket" / "d").iterdir()) == ["f.tex", "g"]


def test_unreadable_files_are_no_clean_files(spark, tmp_path):
    gone = spark.createDataFrame([(str(tmp_path / "x.tex"), ".tex"), ("file:///none/x.jpg", ".jpg")], "path string, suffix string")
    assert all(r.error.startswith("not read") for r in scrub_rows(files.with_content(gone)).collect())


def test_files_too_large_are_reported(spark, tmp_path):
    file = tmp_path / "x.tex"
    file.write_bytes(b"\\author{Ann}\n")
    rows = spark.createDataFrame([(str(file), ".tex"), (f"file://{file}", ".tex")], "path string, suffix string")
    assert all(r.error.startswith("not read") and r.data is None for r in scrub_rows(files.with_content(rows, 12)).collect())
    assert all(r.data == b"\\author{}\n" for r in scrub_rows(files.with_content(rows, 13)).collect())


def test_contents_are_never_dealt_out(spark, tmp_path):
    rows = run.inspect(spark, [str(staged(tmp_path))], recursive=True)
    plan = rows._jdf.queryExecution().optimizedPlan()
    moved = ("Join", "Repartition", "Aggregate", "Sort", "Window")

    def nodes(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    names = {n.nodeName(): n for n in nodes(plan)}
    assert any(k.startswith("Join") for k in names) and "MapInArrow" in names
    for n in nodes(plan):
        if n.nodeName().startswith(moved):
            columns = {n.output().apply(k).name() for k in range(n.output().size())}
            assert not columns & {"content", "data"}, n.nodeName()


def test_names_are_dealt_by_number(spark):
    files_ = spark.range(100).selectExpr("CAST(id AS string) AS path", "'.tex' AS suffix")
    assert files.dealt(files_, 100).rdd.getNumPartitions() == 4 and files.dealt(files_.limit(0), 0).count() == 0


def test_many_small_files_share_tasks_and_batches(spark, tmp_path):
    files_ = spark.range(100).selectExpr("CAST(id AS string) AS path", "'.tex' AS suffix")
    assert files.dealt(files_, 100_000).rdd.getNumPartitions() == 32 and files.dealt(files_, 10_000_000).rdd.getNumPartitions() == 1221
    for i in range(100):
        (tmp_path / f"{i}.tex").write_bytes(b"x" * i)
    names = spark.createDataFrame([(str(tmp_path / f"{i}.tex"), ".tex") for i in range(100)], "path string, suffix string").coalesce(1)
    batches = files.with_content(names).mapInArrow(lambda bs: (b.select(["path"]).slice(0, 1) for b in bs), "path string")
    assert batches.count() == 1 and {len(r.content) for r in files.with_content(names).collect()} == set(range(100))


def test_folders_are_listed_as_pathlib_does(tmp_path):
    for name in ("b/x.tex", "b.c/x.tex", "b/a.TEX", "a b/.tex", "a b/..jpg", "a b/x.", "a b/x.y.bib", "a b/sub/deep.png", "z.c2pa"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "through").symlink_to(tmp_path / "b")
    (tmp_path / "file.tex").symlink_to(tmp_path / "b/x.tex")
    (tmp_path / "broken.tex").symlink_to(tmp_path / "none")
    (tmp_path / "loop.tex").symlink_to(tmp_path / "loop.tex")
    for recursive in (True, False):
        wanted = [str(p) for p in sorted(tmp_path.rglob("*") if recursive else tmp_path.iterdir()) if p.suffix.lower() in files.SUFFIXES and p.is_file()]
        assert [f for _, f, _ in files.rooted([str(tmp_path)], recursive)] == wanted
    for p in [*tmp_path.rglob("*"), *map(files.Path, ("/x.tex", "x.tex", "a/.b", "a/b.c.d"))]:
        assert files.named(str(p)) == (str(p.parent), p.name, p.stem, p.suffix)


def test_failed_writes_to_addresses_leave_nothing_behind(tmp_path):
    (tmp_path / "d" / "g").mkdir(parents=True)
    try:
        files.atomic_write(f"file://{tmp_path}/d/g", b"data")
        raise AssertionError("written over a folder")
    except OSError:
        assert [p.name for p in (tmp_path / "d").iterdir()] == ["g"]
    files.atomic_write(f"file://{tmp_path}/new/er/x", b"data" * 100_000)
    assert (tmp_path / "new/er/x").read_bytes() == b"data" * 100_000


def test_names_are_listed_once_and_stored(spark, tmp_path):
    (tmp_path / "a.tex").write_bytes(b"x")
    listed = files.inventory(spark, [str(tmp_path)])
    around = files.siblings(spark, listed)
    assert listed.inputFiles() and around.inputFiles()
    (tmp_path / "b.tex").write_bytes(b"x")
    assert listed.count() == around.count() == 1 and files.inventory(spark, []).count() == 0
