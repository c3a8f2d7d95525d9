"""One query per operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilmark.functions import audio, metrics, text
from tilmark.operators.align import align, token_set_scores
from tilmark.operators.match import best_verses
from tilmark.operators.segment import segment
from tilmark.operators.transcribe import WordStub, transcribe
from tilmark.plans.report import with_report
from tilmark.plans.tables import SPEECH_ABOVE, corpus, dressed, frames, hypotheses, said, table
from tilmark.plans import store
from tilmark.sources import corpus as corpora

CHUNK, OVERLAP = 24, 4
PIECE = 512
SPLIT = 1 << 16
STUB_STEP = 8
STUB_WORDS = ["one", "two", "three", "four", "five", "six", "seven"]


def norm_full(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalise(dressed("text")).alias("plain"))


def norm_steps(spark, d):
    steps = {"no_marks": text.strip_diacritics, "alef": text.fold_alef, "waw": text.fold_waw, "ya": text.fold_ya, "no_tatweel": text.strip_tatweel, "spaces": text.collapse_ws, "stripped": text.py_strip}
    t = dressed("text")
    return table(spark, d, "conversations").select("conv_id", "turn", *[f(t).alias(n) for n, f in steps.items()], text.remove_spaces("text").alias("joined"))


def tokenise(spark, d):
    words = text.tokenise(dressed("text"))
    return table(spark, d, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("n_words"), F.try_element_at("w", F.lit(1)).alias("first_word"), F.try_element_at("w", F.lit(-1)).alias("last_word"), F.size(F.array_distinct("w")).alias("n_distinct"))


def strip_end_of_ayah(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.strip_end_of_ayah(F.concat(F.lit("  "), "text", F.lit(" ۝ "))).alias("clean"))


def _turns(spark, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.normalise(dressed("text")).alias("hyp"), text.normalise(dressed(F.coalesce(before, F.lit("")))).alias("ref"))


def _words(spark, d):
    return _turns(spark, d).select("conv_id", "turn", text.tokenise("hyp").alias("h"), text.tokenise("ref").alias("r"))


def wer(spark, d):
    return _words(spark, d).select("conv_id", "turn", metrics.wer(F.col("h"), F.col("r")).alias("wer"))


def accuracy(spark, d):
    return wer(spark, d).select("conv_id", "turn", metrics.word_accuracy("wer").alias("accuracy"), metrics.fixed(metrics.word_accuracy("wer"), 1).alias("shown"))


def micro_wer(spark, d):
    w = _words(spark, d)
    return w.agg((F.sum(metrics.word_distance(F.col("h"), F.col("r"))) / F.sum(F.size("r"))).alias("wer"))


def _pairs(spark, d):
    return hypotheses(spark, d).join(corpus(spark, d), ["surah", "ayah"]).select("hyp_id", text.normalise("text").alias("hyp"), F.col("plain").alias("ref"))


def cer(spark, d):
    return _pairs(spark, d).select("hyp_id", metrics.cer("hyp", "ref").alias("cer"))


def indel_ratio(spark, d):
    from tilmark.functions.register import register

    register(spark)
    return _pairs(spark, d).selectExpr("hyp_id", "indel_ratio(hyp, ref) AS ratio")


def word_ratio(spark, d):
    """Ratio of each verse's neighbouring words, by expressions."""
    w = corpus(spark, d).select("idx", text.tokenise("plain").alias("w"))
    each = w.select("idx", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("place", "p"))
    return each.filter("p.b is not null").select("idx", "place", metrics.ratio(F.col("p.a"), F.col("p.b")).alias("ratio"))


def token_set(spark, d):
    return _pairs(spark, d).select("hyp_id", token_set_scores("hyp", "ref").alias("score"))


def _searched(spark, d, scope, threshold=40.0):
    h = hypotheses(spark, d).select("hyp_id", text.normalise("text").alias("hypothesis"), (F.col("surah") if scope else F.lit(None).cast("int")).alias("scope"))
    return best_verses(h, corpus(spark, d), threshold).select("hyp_id", "idx", "match_score")


def fuzzy_top1_scoped(spark, d):
    return _searched(spark, d, True)


def fuzzy_top1_global(spark, d):
    return _searched(spark, d, False)


def fuzzy_top1_blocks(spark, d):
    """fuzzy_top1_global with the corpus left distributed, in blocks of 7 verses."""
    from tilmark.operators.match import best_verses_by_blocks

    h = hypotheses(spark, d).select("hyp_id", text.normalise("text").alias("hypothesis"), F.lit(None).cast("int").alias("scope"))
    return best_verses_by_blocks(h, corpus(spark, d), size=7).select("hyp_id", "idx", "match_score")


def fuzzy_top1_turns(spark, d):
    h = table(spark, d, "conversations").select(F.xxhash64("conv_id", "turn", "text").alias("hyp_id"), text.normalise(dressed("text")).alias("hypothesis"), F.lit(None).cast("int").alias("scope"))
    return best_verses(h, corpus(spark, d), spread=spark.sparkContext.defaultParallelism).select("hyp_id", "idx", "match_score")


def below_threshold(spark, d):
    return align(hypotheses(spark, d).withColumn("ayah", F.lit(None).cast("int")), corpus(spark, d), 80.0).select("hyp_id", "match_status", "surah", "ayah")


def _exact(spark, d):
    return align(hypotheses(spark, d), corpus(spark, d))


def exact_match(spark, d):
    return _exact(spark, d).select("hyp_id", "match_status", "surah", "ayah", "wer", "cer", "match_score")


def not_found(spark, d):
    return align(hypotheses(spark, d).withColumn("ayah", F.col("ayah") + 5), corpus(spark, d)).select("hyp_id", "match_status", "surah", "ayah", "wer")


def align_words(spark, d):
    each = _exact(spark, d).select("hyp_id", F.posexplode("word_alignments").alias("place", "w"))
    return each.select("hyp_id", "place", "w.*")


def align_words_sql(spark, d):
    """align_words by SQL: a lateral join with a table function."""
    from tilmark.functions.register import register

    register(spark)
    pairs = hypotheses(spark, d).join(corpus(spark, d), ["surah", "ayah"]).select("hyp_id", text.normalise("text").alias("hyp"), "plain", "original")
    return spark.sql("SELECT hyp_id, w.* FROM {pairs} p, LATERAL aligned_words(p.hyp, p.plain, p.original) w", pairs=pairs)


def _documents_said(spark, d):
    """Whole documents, and how they might be heard; dealt out, as they come in a few small files."""
    return table(spark, d, "documents").repartition(4 * spark.sparkContext.defaultParallelism).select("doc_id", text.normalise(dressed("text")).alias("ref")).select("doc_id", "ref", said(text.tokenise("ref")).alias("h"))


def align_documents(spark, d):
    """Word alignments of whole documents: how many words of each status, and the statuses in order as a digest."""
    from tilmark.operators.align import word_alignments

    pairs = _documents_said(spark, d).select("doc_id", F.array_join("h", " ").alias("hypothesis"), F.col("ref").alias("reference_plain"), F.col("ref").alias("reference_with_diacritics"))
    out = word_alignments(pairs, fields=["status"])
    kinds = F.array_join(F.transform("word_alignments", lambda w: F.substring(w["status"], 1, 1)), "")
    count = lambda kind: F.when(F.col("kinds").isNull(), F.col("size")).otherwise(F.length("kinds") - F.length(F.replace("kinds", F.lit(kind[0])))).alias(f"n_{kind}")
    return out.select("doc_id", kinds.alias("kinds"), F.size("word_alignments").alias("size")).select("doc_id", *[count(k) for k in ("correct", "substitution", "deletion", "insertion")], F.sha2("kinds", 256).alias("statuses_sha256"))


def wer_documents(spark, d):
    from tilmark.operators.align import word_error_rates

    pairs = _documents_said(spark, d).select("doc_id", F.array_join("h", " ").alias("hypothesis"), F.col("ref").alias("reference_plain"))
    return word_error_rates(pairs).select("doc_id", "wer")


def align_counts(spark, d):
    each = _exact(spark, d).select("hyp_id", F.explode("word_alignments").alias("w"))
    count = lambda s: F.count_if(F.col("w.status") == s)
    return each.groupBy("hyp_id").agg(*[count(s).alias(f"n_{s}") for s in ("correct", "substitution", "deletion", "insertion")], F.count("*").alias("total"))


def correct_words(spark, d):
    return _exact(spark, d).select("hyp_id", F.array_join("correctly_recited_words", "|").alias("words"))


def error_words(spark, d):
    return _exact(spark, d).select("hyp_id", F.array_join("error_words", "|").alias("words"))


def report_line(spark, d):
    return with_report(_exact(spark, d)).select("hyp_id", "report")


def corpus_flatten(spark, d):
    document = corpora.nested_json(corpus(spark, d))
    return corpora.index(corpora.flatten_nested(document, "value"))


def _empty_surah(number):
    kind = "struct<number:int,ayahs:array<struct<numberInSurah:int,text:string>>>"
    return F.struct(F.lit(number).alias("number"), F.array().alias("ayahs")).cast(kind)


def corpus_counts(spark, d):
    """Counts of a service document of the corpus that also has a surah without ayahs."""
    ayahs = F.array_sort(F.collect_list(F.struct(F.col("ayah").alias("numberInSurah"), F.col("original").alias("text"))))
    surahs = corpus(spark, d).groupBy("surah").agg(ayahs.alias("ayahs")).agg(F.collect_list(F.struct(F.col("surah").alias("number"), "ayahs")).alias("s"))
    document = F.to_json(F.struct(F.struct(F.concat("s", F.array(_empty_surah(1_000_000))).alias("surahs")).alias("data")))
    return corpora.service_counts(surahs.select(document.alias("document")))


def corpus_file(spark, d):
    """The corpus, written as a JSON file, read and made a table."""
    at = store.fresh(spark, "corpus")
    corpora.nested_json(corpus(spark, d)).coalesce(1).write.text(at)
    return corpora.index(corpora.flatten_nested(corpora.read_json(spark, at)))


def corpus_scan(spark, d):
    """Conversations as one JSON document, cut into turns by many tasks."""
    from tilmark.sources.corpus_scan import scan_nested

    with store.step():
        at = store.fresh(spark, "document")
        corpora.write_nested(table(spark, d, "conversations").select(F.col("conv_id").alias("surah"), F.col("turn").alias("ayah"), "text"), at)
        verses = scan_nested(spark, at, split=SPLIT)
    return verses.select("surah", "ayah", "original")


def ayahs_per_surah(spark, d):
    return corpus(spark, d).groupBy("surah").agg(F.count("*").alias("ayahs"))


def surah_lookup(spark, d):
    return corpora.surah_verses(corpus(spark, d), 2)


def verse_lookup(spark, d):
    from tilmark.operators.match import with_verse

    return with_verse(hypotheses(spark, d).select("hyp_id", "surah", (F.col("ayah") + 3).alias("ayah")), corpus(spark, d)).select("hyp_id", "surah", "ayah", "original")


def api_parse(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    ayahs = F.transform("t", lambda x: F.struct(x["turn"].cast("int").alias("numberInSurah"), F.concat(x["text"], F.lit(" ۝")).alias("text")))
    document = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("conv_id").cast("int").alias("number"), ayahs.alias("ayahs"))).alias("surahs")).alias("data")))
    return corpora.parse_service(turns.select(document.alias("document"))).select("surah", "ayah", "original")


def _waves(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("samples"))


def peak_normalise(spark, d):
    return _waves(spark, d).select("vec_id", F.posexplode(audio.peak_normalise("samples")).alias("place", "sample"))


def peak(spark, d):
    return _waves(spark, d).select("vec_id", audio.peak("samples").alias("peak"))


def duration(spark, d):
    return _waves(spark, d).select("vec_id", audio.duration("samples").alias("seconds"))


def min_duration(spark, d):
    return table(spark, d, "documents").select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w).cast("float")).alias("samples")).filter(audio.long_enough("samples", 300)).select("doc_id", F.size("samples").alias("n"))


def downmix(spark, d):
    half = F.array(F.slice("samples", 1, 32), F.slice("samples", 33, 32))
    return _waves(spark, d).select("vec_id", F.posexplode(audio.downmix(half)).alias("place", "sample"))


def _chunks(waves, cut):
    each = waves.select("vec_id", F.posexplode(cut).alias("chunk", "c"))
    return each.select("vec_id", "chunk", F.size("c").alias("n"), F.element_at("c", 1).alias("first_sample"), F.element_at("c", -1).alias("last_sample"))


def chunks_tumbling(spark, d):
    return _chunks(_waves(spark, d), audio.tumbling_chunks("samples", CHUNK))


def chunks_overlap(spark, d):
    return _chunks(_waves(spark, d), audio.overlapping_chunks("samples", CHUNK, OVERLAP))


def pcm_decode(spark, d):
    raw = F.encode("p_name", "UTF-8")
    return table(spark, d, "part").select("p_partkey", F.posexplode(audio.pcm16_to_float(raw)).alias("place", "sample"))


def text_join(spark, d):
    parts = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    said = F.filter(F.transform("t", lambda x: text.py_strip(x["text"])), lambda x: x != "")
    return parts.select("conv_id", F.array_join(said, " ").alias("joined"))


def vad_segments(spark, d):
    return segment(frames(spark, d)).select("stream_id", "segment_no", "start_seq", "end_seq", F.size("seqs").alias("n_frames"), F.hex("raw").alias("raw_hex"))


def vad_frames_preroll(spark, d):
    return segment(frames(spark, d)).select("stream_id", "segment_no", F.posexplode("seqs").alias("place", "seq"))


def vad_segments_pieces(spark, d):
    """All events as one stream of frames, segmented by many tasks."""
    from tilmark.operators.segment_pieces import segment_pieces

    one = table(spark, d, "events").select(F.lit(0).cast("long").alias("stream_id"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").cast("binary").alias("payload"), (F.col("value") > SPEECH_ABOVE).alias("is_speech"))
    return segment_pieces(one, size=PIECE, parts=spark.sparkContext.defaultParallelism).select("stream_id", "segment_no", "start_seq", "end_seq", F.size("seqs").alias("n_frames"), F.hex("raw").alias("raw_hex"))


def _streamed(spark, d, run, **named):
    """Segments by Structured Streaming over stored frames; run ends the started query."""
    from tilmark.streaming import live

    base = store.fresh(spark, "stream")
    frames(spark, d).write.parquet(f"{base}/frames")
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    live.rocksdb(spark)
    try:
        found = live.live_segments(live.read_frames(spark, f"{base}/frames"), **named)
        run(found.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint"), f"{base}/segments")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.read.schema(found.schema).parquet(f"{base}/segments").select("stream_id", "segment_no", "start_seq", "end_seq", F.size("seqs").alias("n_frames"), F.hex("raw").alias("raw_hex"))


def vad_stream(spark, d):
    """The segments of vad_segments, by Structured Streaming."""
    return _streamed(spark, d, lambda writer, at: writer.trigger(availableNow=True).start(at).awaitTermination())


def vad_stream_flush(spark, d):
    """The same, and the segments that are open when the streams have fallen silent, ended by timers."""
    from tilmark.streaming import live

    return _streamed(spark, d, lambda writer, at: live.drain(writer.trigger(processingTime="0 seconds").start(at)), flush_after=0)


def resample(spark, d):
    from tilmark.sources.audio_files import resampled

    return _waves(spark, d).select("vec_id", F.posexplode(resampled("samples", 8000)).alias("place", "sample")).withColumn("sample", F.round(F.col("sample").cast("double"), 5))


def wav_decode(spark, d):
    """Names of parts as WAV files of 32 stereo samples of 16 bits at 16 kHz, decoded."""
    from tilmark.sources.audio_files import decoded

    header = bytes.fromhex("52494646a400000057415645666d74201000000001000200803e000000fa0000040010006461746180000000")
    payload = F.rpad(F.encode("p_name", "UTF-8"), 128, bytes(1))
    files = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit(header), payload).alias("content"))
    return decoded(files, normalise=False).select(F.col("path").cast("long").alias("p_partkey"), "error", F.posexplode("samples").alias("place", "sample"))


def wav_chunks(spark, d):
    """All events as one WAV file at 8 kHz, read as chunks of 1,000 samples at 16 kHz with 100 in common, scaled by the peak of the file."""
    from tilmark.sources.audio_blocks import read_chunks, write_wav

    with store.step():
        value = (F.col("event_id") * 7919 % 60_000 - 30_000) * F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
        at = write_wav(table(spark, d, "events").select(F.col("event_id").alias("i"), value.alias("sample")), store.fresh(spark, "waves"), 8000)
        chunks = read_chunks(spark, at, 1000, 100)
    return chunks.select("chunk", "start", F.posexplode("samples").alias("place", "sample")).withColumn("sample", F.round(F.col("sample").cast("double"), 5))


def _stub():
    return WordStub(STUB_WORDS, STUB_STEP)


def transcribe_stub(spark, d):
    heard = transcribe(_waves(spark, d), _stub, chunk_seconds=CHUNK / 16_000, timestamps=True)
    return heard.select("vec_id", "transcript.text", "transcript.duration_s", F.size("transcript.chunks").alias("n_chunks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (
        "norm_full norm_steps tokenise strip_end_of_ayah wer accuracy micro_wer cer indel_ratio word_ratio token_set fuzzy_top1_scoped fuzzy_top1_global fuzzy_top1_blocks fuzzy_top1_turns "
        "below_threshold exact_match not_found align_words align_words_sql align_documents wer_documents align_counts correct_words error_words report_line corpus_flatten corpus_file corpus_scan corpus_counts ayahs_per_surah surah_lookup verse_lookup "
        "api_parse peak_normalise peak duration min_duration downmix chunks_tumbling chunks_overlap pcm_decode text_join vad_segments vad_segments_pieces vad_frames_preroll vad_stream vad_stream_flush resample wav_decode wav_chunks transcribe_stub"
    )
    return {n: globals()[n] for n in names.split()}
