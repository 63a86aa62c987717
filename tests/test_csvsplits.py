import random
import time

import pytest

from quaystone.sources.csvsplits import inside_after, parse, read_csv


def plain(text):
    """(row number, cells) by reading one letter after another."""
    text = text.removeprefix("﻿")
    rows, n, at = [], 0, 0

    def cell(at):
        """A cell's value, and where it ends."""
        if at < len(text) and text[at] == '"':
            i, value = at + 1, ""
            while i < len(text):
                if text[i] == '"' and text[i + 1 : i + 2] == '"':
                    value += '"'
                    i += 2
                elif text[i] == '"':
                    if i + 1 == len(text) or text[i + 1] in ",\r\n":
                        return value, i + 1
                    j = i
                    while j < len(text) and text[j] not in ",\r\n":
                        j += 1
                    return text[at:j], j
                else:
                    value += text[i]
                    i += 1
        j = at
        while j < len(text) and text[j] not in ",\r\n":
            j += 1
        return text[at:j] or None, j

    while at < len(text):
        cells = []
        while True:
            value, at = cell(at)
            cells.append(value)
            if at < len(text) and text[at] == ",":
                at += 1
                continue
            break
        at += 2 if text[at : at + 2] == "\r\n" else 1
        while cells and cells[-1] is None:
            cells.pop()
        if cells:
            n += 1
            rows.append((n, cells))
    return rows


@pytest.fixture
def splits(spark):
    """Files are cut every few bytes."""

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield cut
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def test_letters_one_by_one():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice('ab,,""\n\r ') for _ in range(rng.randrange(25)))
        assert [c for c in parse(text) if c] == [c for _, c in plain(text)], text
    assert not inside_after('a,"b""c",d"e', False) and inside_after('a,"b', False) and not inside_after('b"x,c', True) and inside_after('b",",', True)


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_splits_at_any_place(spark, splits, tmp_path, size):
    rng = random.Random(size)
    texts = ["", "﻿a,b\n1,2\n", 'x,"never closed\ny,z\nlast,1\n', "only\rold\rlines", '"' + "long\n" * 30 + '",end\r\nnext']
    for _ in range(9):
        cells = ["", "a", "b c", '"q, r"', '"two\nlines"', '"d""q"', 'in"side', '"x"y', '"t\r\nu"', '"é,€"', '""', '"\n\n\n"']
        texts.append("".join(",".join(rng.choice(cells) for _ in range(rng.randrange(1, 6))) + rng.choice(["\n", "\r\n"]) for _ in range(40)))
    splits(size)
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.csv").write_bytes(t.encode())
    got = {}
    for r in read_csv(spark, f"file://{tmp_path}/*.csv").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.row_index, r.cells))
    for i, t in enumerate(texts):
        assert sorted(got.get(f"f{i}.csv", [])) == plain(t), (i, t)


def test_one_file_in_many_tasks_and_wide_records(spark, splits, tmp_path):
    wide = ",".join(f"c{i}" for i in range(100_000))
    (tmp_path / "w.csv").write_text("Customer,MPN\n" + "".join(f'n{i},"p,{i}"\n' for i in range(3000)) + wide + "\n")
    splits(64_000)
    df = read_csv(spark, f"file://{tmp_path}/w.csv")
    assert df.rdd.getNumPartitions() > 5
    began = time.time()
    rows = {r.row_index: r.cells for r in df.collect()}
    assert time.time() - began < 20
    assert len(rows) == 3002 and rows[3001] == ["n2999", "p,2999"] and len(rows[3002]) == 100_000 and rows[3002][-1] == "c99999"
