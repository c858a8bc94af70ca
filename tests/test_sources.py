"""Array files read by ranges, and batched uploads with a ledger."""

import json
import random

import pytest
from pyspark.sql import functions as F

from coursemetrics.sources import upload
from coursemetrics.sources.binding import Binding
from coursemetrics.sources.json_ranges import _chunks, array_records, read_array_files
from coursemetrics.sources.raw import read_raw, statements_from_silver
from coursemetrics.sources.schemas import EVENT_SCHEMA
from paths import SF_SMALL

ODD = ["}", "{", "]", "[", '"', "\\", "},{", "é中", "\n", "a", " ", ",", "\\\"", "}}"]


@pytest.fixture
def ranges_of(spark):
    """Bytes that a task reads of a file."""
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    yield lambda size: spark.conf.set(key, size or old)
    spark.conf.set(key, old)


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return rng.choice([None, True, 1, -2.5])
    if kind < 3:
        return "".join(rng.choices(ODD, k=rng.randrange(6)))
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choices(ODD, k=2)) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("indent,ascii_only,range_bytes", [(None, True, 64), (2, False, 97), (None, False, 4096), (None, True, None)])
def test_any_array_gives_its_records(spark, tmp_path, indent, ascii_only, range_bytes, ranges_of):
    ranges_of(range_bytes)
    rng = random.Random(indent or 7)
    for f in range(3):
        rows = [{"id": i, "v": value(rng)} for i in range([40, 1, 0][f])]
        (tmp_path / f"{f}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    got = array_records(spark, str(tmp_path)).collect()
    name = {r.file: r.path for r in spark.read.format("binaryFile").load(str(tmp_path)).select(
        F.col("path"), F.xxhash64("_metadata.file_path").alias("file")).collect()}
    for f in range(3):
        want = json.loads((tmp_path / f"{f}.json").read_text(encoding="utf-8"))
        mine = sorted((r.record, r.text) for r in got if name[r.file].endswith(f"/{f}.json"))
        assert [json.loads(t) for _, t in mine] == want and [n for n, _ in mine] == list(range(len(want)))


def test_ranges_equal_the_reader_of_whole_files(spark, tmp_path, ranges_of):
    statements = statements_from_silver(Binding(spark, SF_SMALL).silver)
    lines = [r.j for r in statements.select(F.to_json(F.struct("*")).alias("j")).collect()]
    path = tmp_path / "events.json"
    path.write_text("[" + ",\n".join(lines) + "]", encoding="utf-8")
    ranges_of(20_000)
    assert _chunks(spark, str(path)).select("start").distinct().count() > 10
    got = read_array_files(spark, str(path), EVENT_SCHEMA)
    same = lambda df: sorted(r.j for r in df.select(F.to_json(F.struct("*")).alias("j")).collect())
    assert same(got) == same(read_raw(spark, str(path), EVENT_SCHEMA))


def test_a_file_that_breaks_off(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "x"}, {"id": "y", "actor": {"name": "n"')
    rows = read_array_files(spark, str(tmp_path), EVENT_SCHEMA, corrupt="_corrupt_record").collect()
    assert [r.id for r in rows if r._corrupt_record is None] == ["x"] and len(rows) == 2


def uploads(spark, n=230):
    return spark.createDataFrame([(f"c{i:03d}", f"t{i}") for i in range(n)], "course_id string, title string").repartition(3)


def test_every_document_gets_through_once(spark, tmp_path):
    taken = spark.sparkContext.accumulator(0)

    def send(documents):
        assert len(documents) <= 50
        taken.add(len(documents))
        return [True] * len(documents)

    ledger = upload.upload_documents(uploads(spark), send, str(tmp_path)).cache()
    assert ledger.agg(F.sum("documents"), F.sum("succeeded"), F.sum("failed")).first()[:] == (230, 230, 0) and taken.value == 230
    assert sorted(x for r in ledger.collect() for x in r.taken) == [f"c{i:03d}" for i in range(230)]
    assert all(r.documents == 50 or r.batch == max(q.batch for q in ledger.collect() if q.task == r.task) for r in ledger.collect())
    upload.upload_documents(uploads(spark, 240), send, str(tmp_path))   # ten new documents
    assert taken.value == 240


def test_refused_documents_and_failing_batches(spark, tmp_path):
    sent = spark.sparkContext.accumulator(0)

    def send(documents):
        sent.add(len(documents))
        if any(d["course_id"] == "c017" for d in documents):
            raise ConnectionError("no answer")      # its whole batch fails every time
        return [d["course_id"] not in ("c100", "c101") for d in documents]

    ledger = upload.upload_documents(uploads(spark), send, str(tmp_path), batch=10, attempts=2, rounds=1)
    told = ledger.collect()
    bad = [r for r in told if r.failed]
    assert {x for r in bad for x in r.refused} >= {"c017", "c100", "c101"} and any("no answer" in (r.error or "") for r in bad)
    assert sum(r.succeeded + r.failed for r in told) == 230 and all(r.attempts == 2 for r in bad) and all(r.attempts == 1 for r in told if not r.failed)
    in_batch = next(r for r in bad if "c017" in r.refused)
    # Refused documents alone are sent again; the failing batch is sent whole twice.
    assert sent.value == 230 + in_batch.documents + sum(x in ("c100", "c101") for r in bad if r is not in_batch for x in r.refused)
    healed = upload.upload_documents(uploads(spark), lambda documents: [True] * len(documents), str(tmp_path), batch=10)
    assert upload.upload_totals(healed).first()[1:] == (230, 0)
    with pytest.raises(ValueError):
        upload.upload_documents(spark.createDataFrame([(None, "x")], "course_id string, title string"), send, str(tmp_path / "n"))
