from __future__ import annotations

import json

import catalogs
import pyarrow.parquet as pq
import pytest

from tessera import Partition, finalize, open_catalog, tokenize_catalog
from tessera.cli import main
from tessera.operators import selection
from tessera.operators.tokenizer import Tokenizer
from tessera.plans import specs
from tessera.plans.job import share
from tessera.sources.catalog import normalized
from tessera.streaming.tokens import tokenize_stream


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    root = catalogs.make(tmp_path_factory.mktemp("in") / "test_legacysurvey_desi")
    finalize(str(root))
    return root


def test_open(spark, source, tmp_path):
    c = open_catalog(spark, source)
    assert c.name == "test_legacysurvey_desi" and c.is_local and c.partitions == sorted(catalogs.PARTS)
    assert c.read().count() == 22 and c.sample(3).count() == 3
    assert c.read_partition(Partition(5, 1239), ["ebv"], 2).columns == ["ebv"]
    assert c.band_labels("image") == ["des-g", "des-r", "des-z"]
    (tmp_path / "collection.properties").write_text("hats_primary_table_url=main\n")
    (tmp_path / "main").symlink_to(source)
    assert open_catalog(spark, tmp_path).partitions == c.partitions == open_catalog(spark, tmp_path, "main").partitions
    assert normalized("org/name") == "hf://datasets/org/name" and normalized(str(source)) == str(source)
    with pytest.raises(FileNotFoundError):
        open_catalog(spark, tmp_path / "none")


def test_whole_catalog(spark, source, tmp_path):
    out = tmp_path / "out"
    summary = tokenize_catalog(spark, source, out, ["image", "flux_g", "spectrum=DESISpectrum"], row_group_size=4, batch_size=3)
    assert summary.ok and summary.counts.asDict() == {"done": 3, "skipped": 0, "failed": 0, "rows": 22} and summary.finalized
    made = open_catalog(spark, out)
    assert made.schema.names == ["_healpix_29", "object_id", "ebv", "flux_g", "z_spec", "tok_image", "tok_flux_g", "tok_spectrum_desi"]
    rows = made.read(keys=True).collect()
    assert sum(r.tok_image is not None for r in rows) == 19 and sum(r.tok_flux_g is not None for r in rows) == 19
    assert {len(r.tok_spectrum_desi.token) for r in rows} == {273}
    first = sorted((r for r in rows if r._pixel == 119), key=lambda r: r._row)
    assert [r.object_id for r in first] == [f"o0_{i}" for i in range(10)]
    assert made.properties["hats_nrows"] == "22" and made.properties["hats_order"] == "6" and "hats_skymap_order" not in made.properties
    assert pq.read_metadata(out / "dataset/_metadata").num_rows == 22
    assert json.loads((out / "tessera.json").read_text())["modalities"][0]["column"] == "image"
    assert "tok_image" in (out / "README.md").read_text() and (out / "partition_info.csv").read_text() == "Norder,Npix\n4,119\n5,1239\n6,15000\n"
    again = tokenize_catalog(spark, source, out, ["image", "flux_g", "spectrum=DESISpectrum"])
    assert again.counts["rows"] == 0 and again.labels("skipped") == [str(p) for p in sorted(catalogs.PARTS)] and again.finalized
    with pytest.raises(ValueError, match="other modalities"):
        tokenize_catalog(spark, source, out, "flux_g")
    assert tokenize_catalog(spark, source, out, "flux_g", overwrite=True, token_dtype="int32").counts["rows"] == 22
    assert open_catalog(spark, out).schema["tok_flux_g"].dataType.simpleString() == "int"
    stream = tokenize_stream(open_catalog(spark, source), Tokenizer(specs.resolve(open_catalog(spark, source).schema, "flux_g")), str(tmp_path / "s"), str(tmp_path / "c"))
    stream.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 22


def test_limits_and_selection(spark, source, tmp_path):
    s = tokenize_catalog(spark, source, tmp_path / "a", "ebv", max_rows=12)
    assert s.counts["rows"] == 12 and s.labels("done") == ["Norder=4/Npix=119", "Norder=5/Npix=1239"]
    assert open_catalog(spark, tmp_path / "a").read([Partition(5, 1239)]).count() == 2
    assert tokenize_catalog(spark, source, tmp_path / "a", "ebv").counts["rows"] == 5  # a shortened partition counts as done
    assert tokenize_catalog(spark, source, tmp_path / "b", "ebv", max_rows=0).counts["rows"] == 0
    assert tokenize_catalog(spark, source, tmp_path / "c", "ebv", partitions=["6/15000", Partition(4, 119)], max_partitions=1).labels("done") == ["Norder=4/Npix=119"]
    for bad in ({"partitions": ["9/9"]}, {"fetch_mode": "none"}, {"rank": 3, "world_size": 2}):
        with pytest.raises(ValueError):
            tokenize_catalog(spark, source, tmp_path / "d", "ebv", **bad)


def test_shares(spark, source, tmp_path, monkeypatch):
    parts = [tokenize_catalog(spark, source, tmp_path / "a", "ebv", rank=r, world_size=2) for r in (0, 1)]
    assert [p.counts["done"] for p in parts] == [2, 1] and not any(p.finalized for p in parts)
    monkeypatch.setenv("RANK", "")
    monkeypatch.setenv("SLURM_PROCID", "1")
    monkeypatch.setenv("SLURM_NTASKS", "3")
    assert share() == (1, 3) and share(0, 1) == (0, 1)


def test_failures(spark, tmp_path):
    root = catalogs.make(tmp_path / "in_legacysurvey", bad=Partition(4, 119))
    (root / "dataset" / Partition(6, 15000).file).write_bytes(b"no parquet")
    finalize_before = list((tmp_path).glob("*"))
    s = tokenize_catalog(spark, root, tmp_path / "out", ["image", "ebv"])
    assert set(s.errors()) == {"Norder=4/Npix=119", "Norder=6/Npix=15000"} and s.labels("done") == ["Norder=5/Npix=1239"] and not s.finalized
    assert "band" in s.errors()["Norder=4/Npix=119"] and finalize_before
    assert [p.name for p in (tmp_path / "out/dataset").rglob("*") if p.is_file() and not p.name.endswith(".crc")] == ["Npix=1239.parquet"]
    assert tokenize_catalog(spark, root, tmp_path / "lim", ["image"], max_rows=6).counts["rows"] == 6  # failed rows don't count
    with pytest.raises(RuntimeError):
        tokenize_catalog(spark, root, tmp_path / "fast", "ebv", fail_fast=True)


def test_empty_partition(spark, tmp_path):
    root = catalogs.make(tmp_path / "in")
    p = root / "dataset" / Partition(5, 1239).file
    pq.write_table(pq.read_table(p).slice(0, 0), p)
    s = tokenize_catalog(spark, root, tmp_path / "out", "ebv")
    assert s.counts["rows"] == 15 and pq.read_table(tmp_path / "out/dataset" / Partition(5, 1239).file).num_rows == 0


def test_stream_goes_on_after_a_failure(spark, source, tmp_path):
    """New files only are read after a restart, and a failed batch leaves no rows."""
    root = catalogs.make(tmp_path / "in")
    late = root / "dataset" / Partition(6, 15000).file
    held = late.read_bytes()
    late.unlink()
    wanted = specs.resolve(open_catalog(spark, root).schema, "ebv")

    def go(codec=None):
        tokens = Tokenizer(wanted, codec, batch_rows=4)
        tokenize_stream(open_catalog(spark, root), tokens, str(tmp_path / "s"), str(tmp_path / "c"), files_at_once=1).awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(str(tmp_path / "s")).select("object_id").collect())

    first = go()
    assert len(first) == 17 and go() == first
    late.write_bytes(held[: len(held) // 2])
    with pytest.raises(Exception, match="parquet|Parquet|FAILED|length"):
        go()
    late.write_bytes(held)
    assert len(go()) == 22 == len(set(go()))


def test_a_codec_with_a_resource(spark, source, tmp_path):
    """A codec may load what it needs on the driver, and carries it to the tasks."""

    class Lookup:
        def __init__(self, path):
            self.path, self.table = path, None

        def validate(self):
            self.table = json.loads(self.path.read_text())

        def encode(self, batch):
            return [[self.table[batch.modality.name]]] * len(batch.flux)

    weights = tmp_path / "weights.json"
    weights.write_text(json.dumps({"LegacySurveyEBV": 41}))
    assert tokenize_catalog(spark, source, tmp_path / "out", "ebv", codec=Lookup(weights)).counts["rows"] == 22
    assert {r.tok_ebv for r in open_catalog(spark, tmp_path / "out").read().collect()} == {41}
    with pytest.raises(FileNotFoundError):  # before any data are read
        tokenize_catalog(spark, source, tmp_path / "none", "ebv", codec=Lookup(tmp_path / "missing"))
    assert not (tmp_path / "none").exists()


def test_hub_sources_are_refused(spark):
    with pytest.raises(ValueError, match="hub"):
        open_catalog(spark, "owner/dataset")


def test_finalize_refuses_mixed_schemas(spark, tmp_path):
    root = catalogs.make(tmp_path / "in")
    p = root / "dataset" / Partition(6, 15000).file
    pq.write_table(pq.read_table(p).drop_columns("ebv"), p)
    with pytest.raises(ValueError, match="another schema"):
        finalize(str(root))
    with pytest.raises(FileNotFoundError):
        finalize(str(tmp_path / "none"))


def test_command_line(spark, source, tmp_path, capsys):
    assert main(["inspect", str(source)]) == 0 and "image -> LegacySurveyImage" in capsys.readouterr().out
    assert main(["tokenize", str(source), str(tmp_path / "o"), "-m", "ebv", "--no-finalize", "--num-prefetch", "2", "--no-progress"]) == 0
    assert not (tmp_path / "o/partition_info.csv").exists()
    assert main(["finalize", str(tmp_path / "o")]) == 0 and (tmp_path / "o/partition_info.csv").exists()


def test_take_rows(spark):
    df = spark.createDataFrame([(4, 1, 10), (5, 1, 7), (6, 1, 5)], "order int, pixel long, rows long")
    assert [r.take for r in selection.take_rows(df, 12).orderBy("order").collect()] == [10, 2]
    assert [r.take for r in selection.take_rows(df, None).orderBy("order").collect()] == [10, 7, 5]
    assert selection.take_rows(df, 0).count() == 0


@pytest.mark.parametrize("harm", ["page", "type", "gone", "cut"])
def test_a_damaged_file_fails_alone(spark, tmp_path, harm):
    """A broken page, a column of another type, a file that goes and one without its end: the other partitions are made."""
    root = catalogs.make(tmp_path / "in")
    p = root / "dataset" / Partition(5, 1239).file
    whole = p.read_bytes()
    if harm == "page":
        p.write_bytes(whole[:40] + bytes(len(whole[40:4000])) + whole[4000:])
    elif harm == "type":
        t = pq.read_table(p)
        pq.write_table(t.set_column(t.schema.get_field_index("ebv"), "ebv", t["object_id"]), p)
    elif harm == "cut":
        p.write_bytes(whole[: len(whole) // 2])
    catalog = open_catalog(spark, root)
    assert len(catalog.partitions) == 3
    if harm == "gone":
        p.unlink()
    s = tokenize_catalog(spark, catalog, tmp_path / "out", ["image", "ebv"])
    assert s.labels("done") == ["Norder=4/Npix=119", "Norder=6/Npix=15000"] and s.labels("failed") == ["Norder=5/Npix=1239"] and s.counts["rows"] == 15
    assert not s.finalized and not (tmp_path / "out/dataset" / Partition(5, 1239).file).exists()
    said = s.errors()["Norder=5/Npix=1239"]
    assert {"page": "0 of 7 rows could be read: ", "type": "ebv is string, not float", "gone": "Error", "cut": "ArrowInvalid"}[harm] in said
    p.write_bytes(whole)
    again = tokenize_catalog(spark, root, tmp_path / "out", ["image", "ebv"])
    assert again.labels("done") == ["Norder=5/Npix=1239"] and again.finalized and len(again.labels("skipped")) == 2


def test_lost_provenance(spark, source, tmp_path):
    """Without it, the files themselves tell whether they are of the same modalities."""
    tokenize_catalog(spark, source, tmp_path / "out", "ebv")
    (tmp_path / "out/tessera.json").unlink()
    with pytest.raises(ValueError, match="other modalities"):
        tokenize_catalog(spark, source, tmp_path / "out", "flux_g")
    assert tokenize_catalog(spark, source, tmp_path / "out", "ebv", row_group_size=7).labels("skipped")
    assert json.loads((tmp_path / "out/tessera.json").read_text())["asked"] == {"row_group_size": 7}


def test_history(spark, source, tmp_path):
    """What runs tell as rows: the last maker of each partition, and where makers differ; a broken file tells nothing."""
    from tessera.plans import history

    out = str(tmp_path / "out")
    assert history.runs(spark, out).count() == 0 == history.makers(spark, out).count() == history.conflicts(spark, out).count()
    go = lambda what, **how: tokenize_catalog(spark, source, out, what, finalize=False, overwrite=True, **how)
    go(["ebv"], max_partitions=2)
    assert history.conflicts(spark, out).count() == 0
    go(["ebv", "flux_g"], partitions=[Partition(5, 1239)], token_dtype="int32")
    (tmp_path / "out/runs/0-broken.json").write_text("{no json")
    told = history.runs(spark, out).orderBy("run").collect()
    assert [r.codec for r in told] == [None, "HashQuantizer", "HashQuantizer"] and [r.token_dtype for r in told] == [None, "int64", "int32"]
    made = {(r.order, r.token_column): (r.token_dtype, r.run == told[2].run) for r in history.makers(spark, out).collect()}
    assert made == {(4, "tok_ebv"): ("int64", False), (5, "tok_ebv"): ("int32", True), (5, "tok_flux_g"): ("int32", True)}
    found = {(r.token_column, r.what, r.value, r.partitions) for r in history.conflicts(spark, out).collect()}
    assert found == {("tok_ebv", "token_dtype", "int64", 1), ("tok_ebv", "token_dtype", "int32", 1), ("tok_flux_g", "present", "yes", 1)}


def test_no_task_sorts_a_whole_partition(spark, tmp_path):
    """Rows of one partition are sorted by several tasks; its file has them in order, in full row groups, and nothing else is left."""
    from pyspark.sql import functions as F

    from tessera.sources import sink

    n = 5000
    rows = spark.range(n, numPartitions=3).select(F.lit(4).alias("_order"), (F.col("id") % 2).alias("_pixel"), F.floor((n - 1 - F.col("id")) / 2).alias("_row"), F.lit(None).cast("string").alias("_error"), F.col("id"), F.array_repeat("id", 3).alias("list"))
    at: list[int] = []
    kept = sink._pieces
    with pytest.MonkeyPatch.context() as m:
        m.setattr(sink, "_pieces", lambda *a: (out := kept(*a), at.append(out.rdd.getNumPartitions()))[0])
        told = sink.write_partitions(rows, str(tmp_path / "out"), 300).collect()
    assert at == [5] and sorted(tuple(r) for r in told) == [(4, 0, 2500, None), (4, 1, 2500, None)]
    for p in (0, 1):
        f = pq.ParquetFile(tmp_path / "out/dataset" / Partition(4, p).file)
        assert f.read()["id"].to_pylist() == list(range(n - 2 + p, -1, -2)) and f.metadata.num_row_groups == 9
        assert {f.metadata.row_group(g).num_rows for g in range(8)} == {300}
    assert [x.name for x in (tmp_path / "out").iterdir()] == ["dataset"]
    bad = rows.withColumn("_error", F.when((F.col("_row") > 1500) & (F.col("_pixel") == 1), F.concat(F.lit("row "), "_row")))
    assert {tuple(r) for r in sink.write_partitions(bad, str(tmp_path / "bad"), 300).collect()} == {(4, 0, 2500, None), (4, 1, 0, "row 1501")}
    assert not (tmp_path / "bad/dataset" / Partition(4, 1).file).exists()
