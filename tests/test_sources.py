import json

import pytest
from pyspark.sql import functions as F

from ravand.operators.split import check_ratios, shuffled_split
from ravand.operators.stems import match_stems
from ravand.settings import PRESETS, FineTuneSettings, Settings, batch_size, for_cpu, from_arguments, preset
from ravand.sources import manifests, sinks


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("audio_path\ttext\nx.wav\tسلام\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('audio_path,text\nx.wav,"a, b"\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text("audio_path\ttext\nx.wav\ta, b\n", encoding="utf-8")
    (tmp_path / "d.csv").write_text("path,text\nx,y\n", encoding="utf-8")
    read = lambda n: [tuple(r) for r in manifests.read_delimited(spark, str(tmp_path / n)).collect()]
    assert read("a.tsv") == [("x.wav", "سلام")] and read("b.csv") == [("x.wav", "a, b")] and read("c.csv") == [("x.wav", "a, b")]
    with pytest.raises(ValueError, match="audio_path"):
        read("d.csv")
    with pytest.raises(ValueError):
        read("e.xlsx")


def test_jsonl_and_corpus(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"audio_path": "x", "text": "y"}\n\n{"audio_path": "z", "text": "w", "uid": "u"}\n')
    assert manifests.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "train.tsv").write_text('path\tsentence\na.mp3\tsay "hi"\n')
    rows = manifests.read_voice_corpus(spark, str(tmp_path), "train.tsv").collect()
    assert [(r["audio_path"], r["text"], r["split"]) for r in rows] == [(f"{tmp_path}/a.mp3", 'say "hi"', "train")]


def test_listing_and_transcripts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/one.WAV").write_bytes(b"1234")
    (tmp_path / "one.json").write_text(json.dumps({"caption": "c", "transcript": " t "}))
    (tmp_path / "two.txt").write_text("  plain \nnext\n")
    (tmp_path / "null.json").write_text('{"text": null, "caption": "c"}')
    files = manifests.list_files(spark, str(tmp_path), manifests.AUDIO).collect()
    assert [(r["stem"], r["extension"], r["length"]) for r in files] == [("one", "wav", 4)]
    texts = {r["stem"]: r["text"] for r in manifests.read_transcripts(spark, str(tmp_path)).collect()}
    assert texts == {"one": "t", "two": "plain \nnext", "null": None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "one two", "train", 1.0), ("b", "three", "test", 2.0)], "name string, text string, split string, d double")
    for fmt in sinks.FORMATS:
        sinks.write_splits(df, str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet")).where("split = 'test'").count() == 1
    sinks.write_exports(df, "name", "text", str(tmp_path / "exports"))
    md = {r["name"]: r["value"] for r in spark.read.parquet(str(tmp_path / "exports/md")).collect()}
    assert md["a"] == "# Transcription: a\n\none two"
    assert {json.loads(r["metadata"])["n"] for r in sinks.dataset_metadata(df, "split", "d", "text").collect()} == {1}
    new = spark.createDataFrame([("a", "new", "train", 9.0)], df.schema)
    assert {r["name"]: r["text"] for r in sinks.upsert(df, new, "name").collect()} == {"a": "new", "b": "three"}


def test_stems_and_splits(spark):
    audio = spark.createDataFrame([(1, "audio_1"), (2, "audio_2"), (3, "zz"), (4, ""), (5, None), (6, "x_long_audio_name")], "audio_id int, stem string")
    texts = spark.createDataFrame([(10, "audio_1"), (11, "my_audio_2_text"), (12, "audio_1"), (13, "long_audio")], "transcript_id int, stem string")
    assert sorted(tuple(r) for r in match_stems(audio, texts).collect()) == [(1, 10, "exact"), (2, 11, "contains"), (6, 13, "contains")]
    counts = {r["split"]: r["n"] for r in shuffled_split(spark.range(105).withColumnRenamed("id", "k"), "k").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == {"train": 84, "validation": 10, "test": 11}
    with pytest.raises(ValueError):
        check_ratios(0.5, 0.4)


def test_settings(tmp_path):
    for bad in ({"chunk_duration_ms": 0}, {"overlap_ms": -1}, {"overlap_ms": 20000}, {"repetition_threshold": 1.5}, {"max_word_repetition": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert all(preset(n).to_dict() == Settings.from_dict(preset(n).to_dict()).to_dict() for n in PRESETS)
    s = from_arguments(["--preset", "fast", "--chunk-duration", "12.5", "--overlap", "0"])
    assert (s.chunk_duration_ms, s.overlap_ms) == (12500, 0)
    s.save(tmp_path / "s.json")
    assert Settings.load(tmp_path / "s.json") == s
    assert for_cpu(preset("fast")).chunk_duration_ms == 10000 and batch_size(None) == 1 and batch_size(24) == 6


def test_first_existing_file_and_transcripts(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("path\tsentence\na.mp3\thi\n")
    (tmp_path / "talk.txt").write_text("one\ntwo\n")
    rows = manifests.read_voice_corpus(spark, str(tmp_path), ("a.tsv", "b.tsv"), ("dev.tsv", "b.tsv")).collect()
    assert sorted(r["split"] for r in rows) == ["train", "validation"]
    with pytest.raises(FileNotFoundError):
        manifests.read_voice_corpus(spark, str(tmp_path), ("a.tsv", "c.tsv"))
    assert manifests.load_transcript(spark, str(tmp_path), "talk").first()["text"] == "one\ntwo\n"
    with pytest.raises(FileNotFoundError, match="talk_cleaned"):
        manifests.load_transcript(spark, str(tmp_path), "talk", cleaned=True)


def test_fine_tune_settings(tmp_path):
    paths = {"train_data_path": "a", "validation_data_path": "b"}
    made = FineTuneSettings.from_dict({"data": paths, "project_name": "p", "logging_dir": ""})
    assert (made.data.output_dir, made.logging_dir) == ("./output/p", "./logs/p")
    for bad in ({"model_size": "huge"}, {"learning_rate": 0}, {"num_train_epochs": 0}, {"train_data_path": ""}, {"validation_data_path": ""}):
        with pytest.raises(ValueError):
            made.changed(bad)
    other = made.changed({"seed": 7, "lora_r": 4, "warmup_steps": 1, "target_sample_rate": 8000, "unknown": 1})
    assert (other.seed, other.model.lora_r, other.training.warmup_steps, other.data.target_sample_rate) == (7, 4, 1, 8000) and made.seed == 42
    tiers = {gb: made.for_hardware(gb).training for gb in (6, 12, 40, None)}
    assert [(t.per_device_train_batch_size, t.gradient_accumulation_steps, t.fp16, t.bf16) for t in tiers.values()] == [(2, 8, True, False), (4, 4, True, False), (8, 2, False, True), (1, 16, False, False)]
    assert made.for_hardware(6).model.use_4bit and not made.for_hardware(12).model.use_4bit and made.for_hardware(None, cores=2).dataloader_num_workers == 2
    args = other.training_arguments()
    assert args["output_dir"] == "./output/p" and args["warmup_steps"] == 1 and args["seed"] == 7
    other.save(tmp_path / "f.json")
    assert FineTuneSettings.load(tmp_path / "f.json") == other
