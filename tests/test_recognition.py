"""Recognisers in stages, the store of their answers, and sweeps that ask no more than they need."""

import os
import random
import threading
from collections import Counter

from pyspark.sql import functions as F

from scoreframe.operators import row_reading
from scoreframe.sources import answers


def noted(folder, name, answer):
    """A model that writes down what it was asked; workers are other processes."""

    def model(images):
        for i in images:
            with open(os.path.join(folder, name), "ab") as f:
                f.write(i + b"\n")
        return [answer(i) for i in images]

    return model


def asked(folder, name):
    path = os.path.join(folder, name)
    return Counter(open(path, "rb").read().split()) if os.path.exists(path) else Counter()


def test_stages(spark, tmp_path):
    """Later stages see what earlier ones left, equal images once a stage, and nothing twice over runs; failures are asked again."""
    log = str(tmp_path)
    images = spark.createDataFrame([(i, bytearray(b"img%d" % (i % 6))) for i in range(30)] + [(99, None)], "n int, content binary").repartition(4)
    first = noted(log, "first", lambda i: ("C", 0.9) if i[-1:] in b"01" else None if i[-1:] == b"2" else ("", 0.1))
    second = noted(log, "second", lambda i: ("D7", 0.4 if i[-1:] == b"5" else 0.7))
    stages = [answers.Stage("vlm", first), answers.Stage("cnn", second, lambda chord, conf: conf >= 0.5)]
    store = answers.answer_store(spark, f"{tmp_path}/store")
    want = {0: ("C", 0.9, "vlm"), 1: ("C", 0.9, "vlm"), 2: ("D7", 0.7, "cnn"), 3: ("D7", 0.7, "cnn"), 4: ("D7", 0.7, "cnn"), 5: (None, None, None)}
    for _ in range(2):
        out = {r["n"]: (r["chord"], r["conf"], r["stage"]) for r in answers.recognise_in_stages(images, stages, "content", store).collect()}
        assert all(out[i] == want[i % 6] for i in range(30)) and out[99] == (None, None, None)
    assert asked(log, "second") == {b"img%d" % k: 1 for k in (2, 3, 4, 5)}
    assert asked(log, "first") == {b"img0": 1, b"img1": 1, b"img2": 2, b"img3": 1, b"img4": 1, b"img5": 1}
    assert store.read().groupBy("stage", "id").count().where("count > 1").count() == 0 and store.read().count() == 9
    more = spark.createDataFrame([(1, bytearray(b"img0")), (2, bytearray(b"new1"))], "n int, content binary")
    assert {r["n"]: r["chord"] for r in answers.recognise_in_stages(more, stages[:1], "content", store).collect()} == {1: "C", 2: "C"}
    assert asked(log, "first")[b"new1"] == 1 and asked(log, "first")[b"img0"] == 1
    assert answers.recognise_in_stages(images, [], "content", store).where("chord is not null").count() == 0
    assert answers.recognise_in_stages(images.limit(0), stages, "content", store).count() == 0


def test_two_writers_give_one_row_a_key(spark, tmp_path):
    store = lambda: answers.AnswerStore(spark, str(tmp_path / "s"), "id string, who string", ["id"])
    gate = threading.Barrier(4)

    def write(k):
        mine = store()
        rows = spark.createDataFrame([(str(i), f"w{k}") for i in range(k, k + 12)] + [(None, "x")], "id string, who string")
        enter = mine._enter

        def together(*a):
            if not entered[k]:
                entered[k] = True
                gate.wait(120)  # all batches are written before the first entry is made
            return enter(*a)

        mine._enter = together
        numbers[k] = mine.add(rows)

    entered, numbers = [False] * 4, [0] * 4
    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join(240) for t in threads]
    got = store().read().collect()
    assert sorted(numbers) == [1, 2, 3, 4] and sorted(int(r["id"]) for r in got) == list(range(15))
    before = {r["id"]: r["who"] for r in got}
    assert store().add(spark.createDataFrame([("3", "late"), ("77", "b"), ("77", "a")], "id string, who string")) == 5
    assert store().compact() == 6 and [e[1] for e in store().entries()] == ["all"]
    assert {r["id"]: r["who"] for r in store().read().collect()} == before | {"77": "a"}
    store()._write(spark.createDataFrame([("999", "lost")], "id string, who string"))  # a writer that broke off
    assert store().read().where("id = '999'").count() == 0 and answers.AnswerStore(spark, str(tmp_path / "none"), "id string", ["id"]).read().count() == 0


def test_patient():
    tries = []

    def call(image):
        tries.append(image)
        if image == b"bad" or len(tries) < 3:
            raise OSError("busy")
        return ("C", 1.0)

    waits = []
    assert answers.patient(call, 4, waits.append)([b"a", b"bad"]) == [("C", 1.0), None]
    assert waits == [1.0, 2.0, 1.0, 2.0, 4.0] and len(tries) == 7


def test_lazy_sweep_asks_for_open_windows_alone(spark, tmp_path):
    rng = random.Random(6)
    read = {(s, x): (rng.choice(["A", "G7", "Am7", "SKIP", "Bb"]), rng.choice([0.5, 0.85, 0.95])) for s in range(40) for x in range(0, 900, 30)}
    rows = [(s, float(x + 30), f"{s}:{x}".encode(), *read[s, x]) for s, x in read if rng.random() < 0.9]
    windows = spark.createDataFrame([(s, x, bytearray(c), chord, conf) for s, x, c, chord, conf in rows], "strip int, x double, c binary, chord string, conf double")
    model = noted(str(tmp_path), "log", lambda i: read[tuple(map(int, i.split(b":")))])
    lazy = row_reading.sweep_lazily(windows, ["strip"], "c", model, 7)
    got = sorted((r["strip"], r["x"], r["token"]) for r in lazy.collect())
    assert got == sorted((r["strip"], r["x"], r["token"]) for r in row_reading.sweep(windows, ["strip"], lambda w: w).collect()) and len(got) > 100
    taken, calls = {}, Counter()
    for s, x, c, chord, conf in sorted(rows):
        if x - taken.get(s, -99) >= 35:
            calls[c] += 1
            if chord != "SKIP" and conf >= (0.90 if len(chord) <= 2 else 0.82):
                taken[s] = x
    assert asked(str(tmp_path), "log") == calls and len(calls) < len(rows)


def test_mark_ties_and_bounds(spark):
    """Of equal confidences the first crop counts; bands are inclusive; marks without a line below go."""
    marks = spark.createDataFrame([(1, 1, 50.0, 80.0, None, None), (1, 2, 50.0, 81.0, 20.0, 10.0), (1, 3, 90.0, 0.0, None, None), (1, 4, 10.0, 150.0, None, None)], "song int, id int, x double, y double, w double, h double")
    lines = spark.createDataFrame([(1, 7, 100.0)], "song int, line int, y double")
    read = lambda crops: crops.withColumns({"chord": F.concat(F.lit("A"), F.col("crop").cast("string")), "conf": F.when(F.col("crop") >= 2, 0.8).otherwise(0.6)})
    assert [tuple(r) for r in row_reading.read_marks(marks, lines, ["song"], read).select("id", "line", "token").collect()] == [(1, 7, "A2"), (3, 7, "A2")]
