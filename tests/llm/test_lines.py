"""Line dedup: row identity, collisions of digests, hot chunks and odd rows."""

import pytest

from rooftide.llm import linededup

SCHEMA = "doc_id long, text string"
B = "\n".join(f"line {i} of a shared text" for i in range(12))


def removed(spark, rows, find=linededup.dedup):
    got = find(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    return sorted(((g.doc_id, g.text), g.n_removed) for g in got if g.doc_id is not None)


@pytest.mark.parametrize("find", [linededup.dedup, linededup.passages])
def test_rows_that_share_an_id_keep_their_own_chunks(spark, find):
    alone = removed(spark, [(0, B), (1, B)], find)
    beside = removed(spark, [(0, B), (1, B), (1, "other\ntext")], find)
    assert sum(n for _, n in alone) > 0
    assert beside == sorted([*alone, ((1, "other\ntext"), 0)])


@pytest.mark.parametrize("find", [linededup.dedup, linededup.passages])
def test_repeated_rows_lose_the_same_lines(spark, find):
    once = removed(spark, [(0, B), (1, "x\n" + B)], find)
    twice = removed(spark, [(0, B), (1, "x\n" + B), (1, "x\n" + B), (0, B)], find)
    assert twice == sorted(once * 2)


def test_chunks_whose_bytes_differ_are_left_alone(spark, monkeypatch):
    monkeypatch.setattr(linededup, "DIGEST", "substr({x}, 1, 5)")
    rows = [(0, "same a\nb\nc\nd"), (1, "same a\nb\nc\nd"), (2, "same z\ny\nx\nw")]
    got = removed(spark, rows, linededup.passages)
    # pairs that begin with "same a" and "same z" share a digest; the others don't
    assert dict(got)[(2, "same z\ny\nx\nw")] == 0
    assert [n for (i, t), n in got if i == 1] == [3] and [t for (i, t), _ in got if i == 1] == ["same a"]


def test_a_hot_chunk_goes_everywhere(spark):
    rows = [(i, f"own {i}\n{B}\nafter {i}") for i in range(300)]
    got = removed(spark, rows, linededup.passages)
    assert [n for _, n in got] == [0] + [12] * 299


def test_odd_rows(spark):
    schema = "doc_id long, text string, _text string, _id int, at int, digest string, n_x int"
    rows = [(0, B), (1, B), (2, None), (3, ""), (None, B), (4, "a\n\n\nb"), (5, "a\n\n\nb"), (6, "z\n" * 20000)]
    docs = spark.createDataFrame([(i, t, "q", 1, 2, "d", 3) for i, t in rows], schema)
    got = {g.doc_id: g for g in linededup.passages(docs).collect()}
    assert len(got) == len(rows) and all((g._text, g._id, g.at, g.digest, g.n_x) == ("q", 1, 2, "d", 3) for g in got.values())
    assert [(got[i].text, got[i].n_lines, got[i].n_removed) for i in (1, 2, 3, None, 5)] == [("", 12, 12), (None, 0, 0), ("", 1, 0), (B, 12, 0), ("", 4, 4)]
    assert got[6].n_lines == 20001
    assert linededup.passages(spark.createDataFrame([], schema)).count() == 0 and linededup.dedup(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("find", [linededup.dedup, linededup.passages])
def test_texts_of_very_many_lines_take_linear_time(spark, find):
    n = 100_000
    rows = [(0, "\n".join(f"s{i}" for i in range(n))), (1, "\n".join(f"s{i}" if i % 7 else f"own{i}" for i in range(n)))]
    (_, first), ((_, text), gone) = removed(spark, rows, find)
    own = [f"own{i}" for i in range(0, n, 7)]
    assert first == 0 and gone == n - len(text.split("\n")) and set(own) <= set(text.split("\n"))
    if find is linededup.passages:
        assert text == "\n".join(own)
