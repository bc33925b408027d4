import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from scrubjay.plans import queries as own
from scrubjay.plans import recipes
from tools.compare import TABLES, plain


@pytest.fixture(scope="module")
def db(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    df = own.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in (x.asDict(recursive=True) for x in df.collect()))
    assert ours
    if name in own.SQL:
        result = db.execute(own.SQL[name])
        names = [d[0] for d in result.description]
        theirs = Counter(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in result.fetchall())
        assert sorted(names) == columns and ours == theirs


def test_inputs_are_not_idle(spark, sf_dir):
    """The noise is there and goes: counts that are known for this table."""
    rows = entry.entry(spark).collect()
    assert (sum(r.documents for r in rows), sum(r.changed for r in rows), sum(r.removed for r in rows)) == (200, 113, 126)
    files = recipes.inventory(spark, sf_dir)
    assert own.c_collisions(spark, sf_dir).count() == 47 and own.c_sidecars(spark, sf_dir).count() == 37 and files.count() == 200


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    """Without the subpackage and the pipeline the entry imports and lists the other queries."""
    import shutil

    root = Path(__file__).resolve().parent.parent
    for name in ("scrubjay", "tools"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(k for k in q if k.startswith('op') or k == 'pipeline'), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.stdout.split() == [str(len(own.QUERIES)), "[]", str(len(own.SQL))], done.stderr


def test_normal_forms_and_ranges_beside_brute_force(spark, sf_dir):
    import unicodedata

    from scrubjay.functions import chars

    texts = {r.doc_id: r.text for r in recipes.noisy(spark, sf_dir).collect()}
    cleaned = {r.doc_id: r.clean for r in own.QUERIES["t_scrub_default"](spark, sf_dir).collect()}
    forms = {r.doc_id: r for r in own.QUERIES["t_other_forms"](spark, sf_dir).collect()}
    assert forms.keys() == cleaned.keys() == texts.keys()
    for i, t in cleaned.items():
        for form in ("nfd", "nfkc", "nfkd"):
            assert forms[i][form] == unicodedata.normalize(form.upper(), t + own.COMPATIBLE)
    inside = {p for a, b in chars.context_ranges() for p in range(a, b + 1)}
    want = Counter(p for t in texts.values() for p in map(ord, t) if p in inside)
    assert {r.codepoint: r.n for r in own.QUERIES["t_in_ranges"](spark, sf_dir).collect()} == want


def test_context_ranges_are_those_of_unicode_17():
    from scrubjay.functions import chars

    spans = chars.context_ranges()
    assert sum(b - a + 1 for a, b in spans) == 6779 and all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:]))
    inside = {p for a, b in spans for p in range(a, b + 1)}
    assert inside >= {0x1F1AE, 0x1F7DA, 0x1F7FF, 0x0628, 0x0B55, 0x10ED8} and not inside & {0x0B53, 0x10EC9, 0x11B0A, 0x11DF0, ord("a")}
