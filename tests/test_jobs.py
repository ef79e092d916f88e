import datetime as dt
import json

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from ossicle import queries
from ossicle.plans import benchmark
from ossicle.sources import corpora, records
from ossicle.streaming import limits

SF = "/root/testdata/sf0.001"


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["condition_id", *queries.RANKS] and entry.entry(spark).count() > 0
    assert set(queries.SQL) <= set(queries.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "documents", "embeddings", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    columns = sorted(want.columns)
    plain = lambda v: None if v is None else float(v) if isinstance(v, float) else v
    rows = lambda rs: sorted((tuple(plain(v) for v in r) for r in rs), key=str)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    left, right = rows(got.select(*columns).collect()), rows(con.sql(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall())
    assert len(left) == len(right)
    for a, b in zip(left, right):
        assert all(x == y or (isinstance(x, float) and abs(x - y) <= 1e-4 * max(1, abs(y))) for x, y in zip(a, b)), (a, b)


def test_benchmark_rows_and_errors(spark):
    signals = corpora.synthetic(spark, 3, 0.5)
    rows = benchmark.benchmark(spark, signals, ["baseline.gain", "noise.white"], sweep=False)
    assert rows.where("status = 'ok'").count() == 9
    again = benchmark.benchmark(spark, signals, ["baseline.gain", "noise.white"], rows.select("condition_id", "utt_id"), sweep=False)
    assert again.count() == 0
    tasks = signals.limit(1).selectExpr("'x' as condition_id", "'transform' as kind", "'spectral.notch' as transform_key", "'D' as family", "'{\"frequency_hz\": 9e9}' as params_json", "cast(null as double) as margin_db", "utt_id", "spk", "sample_rate", "waveform")
    bad = benchmark.measure(tasks).first()
    assert bad.status == "error" and "ValueError" in bad.error and bad.snr_db is None
    benchmark.register_sql(spark, ["baseline.gain"])
    signals.createOrReplaceTempView("signals")
    assert spark.sql("select size(baseline_gain(waveform, sample_rate)) n from signals").first().n == 8000
    config = {"transforms": [{"type": "baseline.gain", "parameters": {"gain_db": [0.0, 6.0]}}, {"type": "noise.echo", "parameters": {"gain": [0.1, 0.2, 0.3], "delay_ms": 5.0}}]}
    assert benchmark.run_config(spark, config, signals).count() == 18
    t = spark.createDataFrame([("one two three four", 20.0, 0.0)], "ref string, masker_db double, jitter_ms double")
    assert benchmark.recognised(t, ["mock"]).first().wer == 0.5
    with pytest.raises(ValueError):
        benchmark.recognised(t, ["none"])


def test_corpora(spark, tmp_path):
    x = 0.5 * np.sin(np.arange(4000) / 9)
    assert np.abs(corpora.decode_wav(corpora.encode_wav(x, 8000))[1] - x).max() < 1e-4
    libri = tmp_path / "libri/84/121"
    libri.mkdir(parents=True)
    for i in range(2):
        (libri / f"84-121-{i:04d}.wav").write_bytes(corpora.encode_wav(x, 8000))
    (libri / "84-121-0002.wav").write_bytes(b"not audio")
    (libri / "84-121.trans.txt").write_text("84-121-0000 HELLO THERE\n")
    rows = {r.utt_id: r for r in corpora.librispeech(spark, str(tmp_path / "libri")).collect()}
    assert rows["84-121-0000"].transcript == "HELLO THERE" and rows["84-121-0001"].transcript == "" and len(rows["84-121-0000"].waveform) == 8000
    assert rows["84-121-0002"].error and rows["84-121-0002"].waveform is None and rows["84-121-0000"].spk == "84"
    k = tmp_path / "kaldi"
    k.mkdir()
    (k / "a001_u1.wav").write_bytes(corpora.encode_wav(x, 16000))
    (k / "wav.scp").write_text("a001_u1 sph2pipe -f wav a001_u1.wav |\n")
    (k / "text").write_text("a001_u1 some words\n")
    (k / "spk2utt").write_text("spkA other a001_u9\n")
    r = corpora.kaldi(spark, str(k)).first()
    assert (r.spk, r.transcript) == ("a001", "some words")
    (tmp_path / "cv.tsv").write_text("client_id\tpath\tsentence\nc1\ta001_u1.mp3\thi\nc2\tmissing.mp3\tno\n")
    assert [r.transcript for r in corpora.common_voice(spark, str(tmp_path / "cv.tsv"), str(k)).collect()] == ["hi"]
    (tmp_path / "fl.tsv").write_text("id\tfile\ttext\tlanguage\n1\ta001_u1.wav\thallo\tde\n")
    assert corpora.fleurs(spark, str(tmp_path / "fl.tsv"), str(k), "en").count() == 0
    (k / "a001_u1.txt").write_text("beside\n")
    assert corpora.loose(spark, str(k)).first().transcript == "beside"
    back = corpora.write_audio(corpora.synthetic(spark, 2, 0.1), str(tmp_path / "audio"))
    assert len(corpora.decode_wav(bytes(back.first().content))[1]) == 1600


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([["c", "original", "k", "A", "{}", "", "u", "s", "1.5", "ok", "", "inf", "nan", "0.5", "1", "1", "ref"] + ["0.25"] * 8], records.COLUMNS)
    records.append_rows(rows, str(tmp_path / "rows"))
    records.append_rows(rows, str(tmp_path / "rows"))
    r = records.read_rows(spark, str(tmp_path / "rows"))
    assert r.count() == 2 and r.first().snr_db is None and r.first().stoi_proxy is None and r.first().mbsd == 0.5 and r.first().wer_whisper_tiny == 0.25 and len(r.columns) == 25
    doc = {"experiment_id": "e", "results": [{"condition_index": 0, "sample_id": "s", "metrics": {"snr_db": 1.0, "x": 2.0}, "snr_db": 9.0}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    got = {m.metric: m.value for m in records.read_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"snr_db": 9.0, "x": 2.0}
    small = spark.createDataFrame([("a_b", None, 0.12345)], "name string, gone double, v double")
    assert "| a_b | — | 0.123 |" in records.markdown(small) and r"a\_b & — & 0.123 \\" in records.latex(small)
    assert json.loads(records.json_text(small))[0]["gone"] is None and records.clean({1: {2.0, 1.0}, "x": float("nan")}) == {"1": [1.0, 2.0], "x": None}


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    req = spark.createDataFrame([("c", t0 + dt.timedelta(seconds=s)) for s in (0, 1, 2, 61)], "client string, ts timestamp")
    req.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(req.schema).parquet(str(tmp_path / "in"))
    q = limits.rate_limited(stream, "client", "ts", 2).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [r.accepted for r in spark.table("limited").orderBy("ts").collect()] == [True, True, False, True]
    for _ in range(2):
        a = limits.append_facts(stream, str(tmp_path / "facts"), str(tmp_path / f"check{_}"), ["client", "ts"]).trigger(availableNow=True).start()
        assert a.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 4
    h = limits.hourly(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in")))
    assert h.isStreaming and h.columns == ["window", "event_type", "n", "total"]
