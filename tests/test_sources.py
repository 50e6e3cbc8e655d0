import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorscape.operators import audio, embedding
from vectorscape.sources import catalog, config
from vectorscape.sources import io as sinks
from vectorscape.sources.schemas import AV_COLUMNS, METADATA_COLUMNS


def metadata_file(tmp_path, rows):
    path = tmp_path / "meta.csv"
    path.write_text("\n".join([",".join(METADATA_COLUMNS), *(",".join(r) for r in rows)]), encoding="utf-8")
    return str(path)


ROW = ["s1", "Q1", "Ann", '"A ""b"""', "12.5", "m", '"m1, m2"', '"1,2"', '"Rap,Holiday"', '"1,2"', "t", "1", "st", "1"]


def test_two_loaders(spark, tmp_path):
    rows = [ROW, ["s2", *ROW[1:8], "Holiday", *ROW[9:]], ["s1", "Q9", "Bob", *ROW[3:]]]
    meta = catalog.read_csv(spark, metadata_file(tmp_path, rows), METADATA_COLUMNS)
    av_path = tmp_path / "av.csv"
    av_path.write_text("Song,Arousal,Valence\ns1,0.5,0.25\ns2,0.1,0.2\n")
    av = catalog.read_csv(spark, str(av_path), AV_COLUMNS)
    tracks = catalog.load_catalog(meta, av).orderBy("quadrant").collect()
    assert [(t.track_id, t.quadrant, t.title, t.genre_tags_consolidated) for t in tracks] == [("s1", "Q1", 'A "b"', ["Hip-Hop/Rap"]), ("s1", "Q9", 'A "b"', ["Hip-Hop/Rap"])]
    split = spark.createDataFrame([("s1", "Q3")], "song_id string, quadrant string")
    (t,) = catalog.load_split(meta, av, split).collect()
    assert (t.artist, t.quadrant, t.duration_s) == ("Bob", "Q3", 12.5)
    with pytest.raises(Exception, match="no metadata for"):
        catalog.load_split(meta, av, spark.createDataFrame([("s9", "Q3")], split.schema)).collect()


def test_missing_columns_raise(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Song,Arousal\na,1\n")
    with pytest.raises(ValueError, match="Valence"):
        catalog.read_csv(spark, str(path), AV_COLUMNS)


def test_sampling(spark):
    df = spark.range(50).withColumnRenamed("id", "track_id")
    a, b = ([r.track_id for r in catalog.sample_uniform(df, 10, "track_id").collect()] for _ in range(2))
    assert a == b and len(set(a)) == 10 and set(a) <= set(range(50))
    assert [r.track_id for r in catalog.sample_uniform(df, 10, "track_id", order="track_id").collect()] == sorted(a)
    assert {r.track_id for r in catalog.sample_uniform(df, 10, "track_id", seed=8).collect()} != set(a) and catalog.sample_uniform(df, 99, "track_id").count() == 50
    with pytest.raises(ValueError):
        catalog.filter_tracks(df, [], "uniform")


def test_config(tmp_path):
    p = tmp_path / "conf" / "c.yaml"
    p.parent.mkdir()
    p.write_text("paths: {project_root: .., dataset_root: data, models_root: m, output_root: o}\nmodels: {x: {provider: p}}\nparameters: {knn: {k: 4}}\n"
                 "datasets: {d: {root: r, audio: {dir: a, path: '.*'}, metadata: {train_file: t.csv, name: n, nested: {files: [f1]}, split: {val_file: v.csv}}}}\n")
    c = config.load_config(p)
    d = c.datasets["d"]
    assert c.parameters.knn.k == 4 and c.parameters.umap.n_neighbors == 100
    assert d.metadata["train_file"] == tmp_path / "data/r/t.csv" and d.metadata["name"] == "n" and d.metadata["nested"]["files"] == [tmp_path / "data/r/f1"]
    assert config.split_file(d.metadata, "val") == tmp_path / "data/r/v.csv"
    with pytest.raises(ValueError):
        config.split_file(d.metadata, "test")
    head = "paths: {project_root: .., dataset_root: data, models_root: m, output_root: o}\n"
    audio_part = "audio: {dir: a, path: '.*'}"
    for bad in (head + "models: {}", head + "datasets: {}", head + "models: {}\ndatasets: {d: {" + audio_part + "}}", "- a list", "{"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            config.load_config(p)
    p.write_text(head + "models: {}\ndatasets: {d: {root: r, " + audio_part + "}}")
    assert config.load_config(p).datasets["d"].root == tmp_path / "data/r"
    p.write_text("models: {}")
    with pytest.raises(ValueError):
        config.load_config(p)


def test_sinks(spark, tmp_path):
    clusters = spark.createDataFrame([("b", "C1"), ("a", "C1"), ("é", "C2")], "tag string, cluster string")
    path = tmp_path / "deep" / "labels.json"
    sinks.write_cluster_labels(clusters, str(path))
    assert json.loads(path.read_text(encoding="utf-8")) == {"C1": ["a", "b"], "C2": ["é"]}
    assert {(r.label, r.tag) for r in sinks.read_label_map(spark, str(path)).collect()} == {("C1", "a"), ("C1", "b"), ("C2", "é")}
    np.savez(tmp_path / "v.npz", track_ids=np.array(["a"]), embeddings=np.ones((1, 3)))
    df = sinks.import_npz(spark, str(tmp_path / "v.npz"))
    sinks.save_vectors(df, str(tmp_path / "v"))
    assert sinks.load_vectors(spark, str(tmp_path / "v")).first().embedding == [1.0, 1.0, 1.0]


def wav(y, rate=22050):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, rate, 0, "NONE", ""))
        w.writeframes((np.asarray(y) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_audio(spark):
    t = np.arange(22050) / 22050
    rows = [("a", bytearray(wav(0.5 * np.sin(2 * np.pi * 440 * t)))), ("silent", bytearray(wav(0 * t)))]
    got = {r.song_id: r for r in audio.extract_features(spark.createDataFrame(rows, "song_id string, content binary")).collect()}
    assert len(got["a"].asDict()) == 57 and len(audio.FEATURES) == 56
    assert all(np.isfinite(v) for r in got.values() for k, v in r.asDict().items() if k != "song_id")
    assert got["a"].hpcp_0 > 0.9 and abs(got["a"].spectral_centroid_mean - 440) < 200
    assert got["silent"].hpcp_max == 0.0
    with pytest.raises(ValueError, match="repeated"):
        audio.extract_features(spark.createDataFrame([rows[0]] * 2, "song_id string, content binary"))
    d = audio.durations(spark.createDataFrame([*rows, ("bad", bytearray(b"x"))], "track_id string, content binary"))
    assert {r.track_id: round(r.duration_s, 3) for r in d.collect()} == {"a": 1.0, "silent": 1.0, "bad": 0.0}
    slow = audio.durations(spark.createDataFrame(rows, "track_id string, content binary"), (lambda content: float("nan"), lambda content: -1.0, audio.decoded_duration))
    assert {round(r.duration_s, 3) for r in slow.collect()} == {1.0}
    assert audio.extract_tonal(spark.createDataFrame(rows[:1], "song_id string, content binary")).columns == ["song_id", *audio.TONAL]


def test_embedding_extraction(spark, tmp_path):
    t = np.arange(4000) / 8000
    for name, level in (("one", 0.5), ("two", 0.25)):
        (tmp_path / f"{name}.wav").write_bytes(wav(level * np.sin(2 * np.pi * 100 * t), 8000))
    files = embedding.audio_files(spark, [str(tmp_path / "one.wav"), str(tmp_path / "two.wav")])
    got = {r.track_id: r.embedding for r in embedding.extract_audio(files, lambda: embedding.SignalShape(8000), batch_size=1).collect()}
    assert got.keys() == {"one", "two"} and got["one"][0] == pytest.approx(0.5 / 2**0.5, abs=1e-3) and got["two"][2] == pytest.approx(0.25, abs=1e-2)
    assert embedding.embed_query_audio(lambda: embedding.SignalShape(8000), (tmp_path / "one.wav").read_bytes()) == pytest.approx(got["one"])
    named = embedding.audio_files(spark, [str(tmp_path / "one.wav")], ["first"])
    assert [r.track_id for r in named.collect()] == ["first"]
    with pytest.raises(ValueError):
        embedding.audio_files(spark, ["a", "b"], ["first"])
    with pytest.raises(ValueError, match="repeated"):
        embedding.extract_audio(files.union(files), embedding.SignalShape)
    with pytest.raises(Exception, match="can't be read"):
        embedding.extract_audio(spark.createDataFrame([("x", bytearray(b"no"))], "track_id string, content binary"), embedding.SignalShape).collect()
    docs = spark.createDataFrame([(1, "aa e"), (2, None)], "doc_id long, text string")
    vectors = {r.doc_id: r.embedding for r in embedding.extract_text(docs, embedding.LetterShares).collect()}
    assert vectors[1] == embedding.embed_query_text(embedding.LetterShares, "aa e") == [0.5, 0.25, 0.0, 0.0, 0.0, 0.25] and vectors[2] == [0.0] * 6
    spec = config.ModelSpec("m", "shape", dtype="int7")
    assert embedding.provider_for(spec, {"shape": lambda spec, dtype: (spec.name, dtype)})() == ("m", np.float32)
    with pytest.raises(ValueError, match="unknown provider"):
        embedding.provider_for(spec, {})


def test_pcm_formats():
    x = np.round(np.sin(np.arange(500) / 7) * 20000).astype(int)
    rate80 = (16383 + 14).to_bytes(2, "big") + (22050 << 49).to_bytes(8, "big")
    for width in (1, 2, 3, 4):
        values = x >> 8 if width == 1 else x << 8 * (width - 2)
        want = values / float(1 << (8 * width - 1))
        big = b"".join(int(v).to_bytes(width, "big", signed=True) * 2 for v in values)
        comm = (2).to_bytes(2, "big") + len(x).to_bytes(4, "big") + (8 * width).to_bytes(2, "big") + rate80
        chunks = b"COMM" + len(comm).to_bytes(4, "big") + comm + b"SSND" + (8 + len(big)).to_bytes(4, "big") + bytes(8) + big
        aiff = b"FORM" + (4 + len(chunks)).to_bytes(4, "big") + b"AIFF" + chunks
        au = b".snd" + b"".join(v.to_bytes(4, "big") for v in (28, 0xFFFFFFFF, width + 1, 22050, 2)) + bytes(4) + big
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((2, width, 22050, 0, "NONE", ""))
            w.writeframes(b"".join((int(v) + (128 if width == 1 else 0)).to_bytes(width, "little", signed=width > 1) * 2 for v in values))
        for content in (aiff, au, out.getvalue()):
            y, rate = audio.decode_pcm(content)
            assert rate == 22050 and np.allclose(y, want, atol=1e-6)
    for bad in (b"", b"RIFF", b"ID3", b".snd" + bytes(30), b"FORM" + bytes(8)):
        with pytest.raises(Exception):
            audio.decode_pcm(bad)
