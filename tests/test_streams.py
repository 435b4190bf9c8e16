"""Answers from live tokens, stopping midway, pacing."""

import datetime
import random

import pytest

from folioflow.operators import pacing
from folioflow.operators.reconcile import OversizeError
from folioflow.streaming import jobs
from folioflow.streaming.answers import live_answers

EVENTS = "request_id long, pos int, token string, last boolean, at timestamp"
DAY = datetime.datetime(2024, 1, 1)


def events_of(texts, at=DAY):
    return [(i, n, w, n == len(t.split()) - 1, at) for i, t in texts.items() for n, w in enumerate(t.split())]


def write(spark, path, n, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{path}/part={n}")


def answers(spark, source, out, checkpoint, stop=None, **options):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    made = live_answers(stream, **options)
    done = jobs.run_until(made, out, checkpoint, stop) if stop else jobs.run_available(made, out, checkpoint)
    return done


def read(spark, out):
    return sorted((r.request_id, r.text, r.complete) for r in spark.read.schema("request_id long, text string, complete boolean").parquet(out).collect())


def test_answers_from_scattered_tokens_and_a_stop(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    rng = random.Random(1)
    texts = {i: " ".join(rng.choices("abcdefgh", k=rng.randrange(1, 30))) for i in range(40)}
    rows = events_of(texts)
    rows += rng.sample(rows, 100)  # repeats
    rng.shuffle(rows)
    for n in range(5):
        write(spark, source, n, rows[n::5])
    stop = lambda q: any(p.numInputRows for p in q.recentProgress)
    finished = answers(spark, source, out, checkpoint, stop)
    early = read(spark, out)
    assert not finished and len(early) < len(texts)
    answers(spark, source, out, checkpoint)
    want = sorted((i, t, True) for i, t in texts.items())
    assert read(spark, out) == want and set(early) <= set(want)
    write(spark, source, 9, rows[:20])  # what comes again for an answered request is dropped
    answers(spark, source, out, checkpoint)
    assert read(spark, out) == want


def test_an_idle_request_times_out(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    half = [(1, 1, "b", False, DAY), (1, 0, "a", False, DAY)]
    write(spark, source, 0, half + events_of({2: "x y"}))
    answers(spark, source, out, checkpoint, delay="1 minute", idle_seconds=60)
    assert read(spark, out) == [(2, "x y", True)]
    for n in (1, 2):  # later events move the watermark
        write(spark, source, n, events_of({2 + n: "later"}, DAY + datetime.timedelta(hours=n)))
    answers(spark, source, out, checkpoint, delay="1 minute", idle_seconds=60)
    assert read(spark, out) == [(1, "a b", False), (2, "x y", True), (3, "later", True), (4, "later", True)]


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_is_streamed_as_one_file_or_as_a_folder(spark, tmp_path, files):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    rows.repartition(files).write.parquet(str(tmp_path / "made"))
    (tmp_path / "other.parquet").mkdir()
    rows.where("doc_id < 3").coalesce(1).write.parquet(str(tmp_path / "other.parquet/more"))
    if files == 1:
        (part,) = (tmp_path / "made").glob("part-*.parquet")
        part.rename(tmp_path / "documents.parquet")
    else:
        (tmp_path / "made").rename(tmp_path / "documents.parquet")
    stream = jobs.document_stream(spark, str(tmp_path), "documents.parquet", rows.schema)
    out = str(tmp_path / "out")
    jobs.run_available(stream.select("doc_id"), out, str(tmp_path / "check"))
    assert sorted(r.doc_id for r in spark.read.schema("doc_id long").parquet(out).collect()) == list(range(30))


class Clock:
    def __init__(self):
        self.now, self.slept = 100.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def test_calls_keep_their_distance_and_wait_as_told():
    clock, starts = Clock(), []
    fails = {2: "429 too many requests, retry in 7.5s", 4: "connection reset", 5: "connection reset", 6: '{"retryDelay": "900s"} rate limit'}

    def mapper(segments):
        starts.append(clock.now)
        clock.now += 0.5
        if len(starts) in fails:
            raise ValueError(fails[len(starts)])
        return "ok"

    paced = pacing.PacedMapper(mapper, 2.0, clock=clock, sleep=clock.sleep, longest=600.0)
    assert [paced([]) for _ in range(2)] == ["ok", "ok"]
    assert starts == [100.0, 102.0, 112.0]  # 0.5 s of call, 7.5 s and a margin of 2 s
    with pytest.raises(ValueError, match="rate limit"):
        paced([])
    assert starts[3:] == [114.0, 116.0, 118.5]
    paced([])
    assert all(b - a >= 2.0 for a, b in zip(starts, starts[1:]))
    with pytest.raises(OversizeError):
        pacing.PacedMapper(lambda s: (_ for _ in ()).throw(OversizeError()), 2.0, clock=clock, sleep=clock.sleep)([])
    assert pacing.named_delay("no such thing") is None and pacing.named_delay("HTTP 429") == 30.0
    assert pacing.named_delay("rate limit, retry in 1.2.3 s") == 30.0


def test_batches_are_paced_per_service_key(spark):
    rows = [(d, b, [(f"s{d}-{b}", "text")]) for d in range(6) for b in range(4)]
    batches = spark.createDataFrame(rows, "doc_id long, batch_id int, segments array<struct<seg_id: string, text: string>>").repartition(8)

    def make_clock():
        now = [0.0]

        def sleep(seconds):
            now[0] += seconds

        return lambda: now[0], sleep

    def make_mapper(key):
        import json

        calls = []

        def answer(segments):
            calls.append(1)
            return json.dumps({"translations": [{"segment_id": s["seg_id"], "translated_text": f"{key}:{len(calls)}"} for s in segments]})

        return answer

    got = pacing.map_paced(batches, make_mapper, ["doc_id", "batch_id"], ["k1", "k2", "k3"], 1.5, make_clock=make_clock).collect()
    assert len(got) == 24 and not any(r.error for r in got)
    by_key = {}
    for r in got:
        key, n = r.pairs[0].translated_text.split(":")
        assert key == r.service_key
        by_key.setdefault(key, []).append(int(n))
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in by_key.values()) and len(by_key) == 3


def test_requests_of_one_bucket_end_on_their_own(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    texts = {i: " ".join(f"w{i}-{n}" for n in range(i % 7 + 1)) for i in range(30)}
    idle = [(100, 1, "b", False, DAY), (100, 0, "a", False, DAY)]
    write(spark, source, 0, idle + events_of(texts))
    for n in (1, 2):  # the bucket has new tokens whenever the idle request's time is over
        write(spark, source, n, events_of({200 + n: "later"}, DAY + datetime.timedelta(hours=n)) + [(300, 0, "open", False, DAY + datetime.timedelta(hours=n))])
    write(spark, source, 3, events_of({203: "last"}, DAY + datetime.timedelta(hours=2)))
    answers(spark, source, out, checkpoint, delay="1 minute", idle_seconds=3660, buckets=1)
    want = [(i, t, True) for i, t in texts.items()] + [(200 + n, "later", True) for n in (1, 2)] + [(203, "last", True)]
    got = read(spark, out)
    assert [r for r in got if r[0] != 100] == sorted(want) and [r for r in got if r[0] == 100] in ([], [(100, "a b", False)])
    write(spark, source, 4, events_of({204: "end"}, DAY + datetime.timedelta(hours=5)))
    write(spark, source, 5, events_of({205: "end"}, DAY + datetime.timedelta(hours=5)))
    answers(spark, source, out, checkpoint, delay="1 minute", idle_seconds=3660, buckets=1)
    assert read(spark, out) == sorted(want + [(100, "a b", False), (204, "end", True), (205, "end", True), (300, "open", False)])
