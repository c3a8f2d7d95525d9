"""Command line: align WAV files, or live frames, with a corpus."""

from __future__ import annotations

import argparse
import logging
import sys
from functools import partial
from pathlib import Path

from tilmark.operators.match import THRESHOLD
from tilmark.plans.pipeline import Config


#: Names, choices and defaults of options are fixed values, the public interface.
def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--corpus", required=True, help="stored corpus table, or where to store it")
    shared.add_argument("--document", help="JSON document to make the corpus from")
    shared.add_argument("--url", help="address to download the corpus from")
    shared.add_argument("--surah", type=int)
    shared.add_argument("--ayah", type=int)
    shared.add_argument("--model", required=True, help="speech model")
    shared.add_argument("--device", choices=["cuda", "cpu", "mps"])
    shared.add_argument("--threshold", type=float, default=THRESHOLD)
    shared.add_argument("--verbose", action="store_true")
    out = argparse.ArgumentParser(prog="tilmark", description="Align recitations with a corpus")
    modes = out.add_subparsers(dest="mode", required=True)
    file = modes.add_parser("file", parents=[shared], help="WAV files")
    file.add_argument("audio")
    file.add_argument("--timestamps", action="store_true")
    live = modes.add_parser("realtime", parents=[shared], help="the microphone, or another source of frames")
    live.add_argument("--source", help="module:function that gives frames, instead of the microphone")
    live.add_argument("--checkpoint", required=True)
    live.add_argument("--vad", type=int, default=2, choices=[0, 1, 2, 3])
    return out


def main(argv: list[str] | None = None, make=None, detector=None) -> int:  # noqa: ANN001
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, stream=sys.stderr, format="%(levelname)s %(name)s: %(message)s")
    if args.mode == "file" and "://" not in args.audio and not Path(args.audio).exists():
        print(f"no such file: {args.audio}", file=sys.stderr)
        return 1
    from tilmark.operators.speech import model_detector, with_speech
    from tilmark.operators.transcribe import SpeechModel
    from tilmark.plans.monitor import ProgressLog
    from tilmark.plans.pipeline import run_files
    from tilmark.plans.report import with_report
    from tilmark.session import outer_session
    from tilmark.sources.corpus import load_corpus
    from tilmark.sources.microphone import FrameSource
    from tilmark.streaming import live

    spark = outer_session()
    corpus = load_corpus(spark, args.corpus, args.document, args.url)
    make = make or partial(SpeechModel, args.model, args.device)
    config = Config(args.model, args.device, args.threshold, args.surah, args.ayah, getattr(args, "timestamps", False), getattr(args, "vad", 2))

    def show(rows, *_):  # noqa: ANN001, ANN202
        for r in rows.select("report").toLocalIterator():
            print(r["report"])

    if args.mode == "file":
        bad = 0
        for r in with_report(run_files(spark, args.audio, corpus, make, config)).select("path", "match_status", "error", "report").toLocalIterator():
            if r["match_status"] in ("exact", "matched"):
                print(r["report"])
            else:
                bad += 1
                print(f"{r['path']}: {r['match_status']}" + (f" ({r['error']})" if r["error"] else ""), file=sys.stderr)
        return 1 if bad else 0
    live.rocksdb(spark)
    spark.dataSource.register(FrameSource)
    spark.streams.addListener(ProgressLog())
    reader = spark.readStream.format("frames")
    frames = with_speech((reader.option("device", args.source) if args.source else reader).load(), partial(detector or model_detector, args.vad))
    query = live.start(live.live_segments(frames), corpus, make, show, args.checkpoint, config)
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        query.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
