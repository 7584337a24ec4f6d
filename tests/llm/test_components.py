import random

import pytest

from xqengine.llm import components as C


def by_search(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    least = {}
    for x in sorted(near):
        todo = [x]
        while todo:
            if (y := todo.pop()) not in least:
                least[y] = x
                todo += near[y]
    return {x: m for x, m in least.items() if near[x] != {x}}


def edges():
    rnd = random.Random(3)
    chain = [rnd.randrange(-(1 << 62), 1 << 62) for _ in range(60)]
    return [*zip(chain, chain[1:]), (7, 7), *((1, x) for x in range(2, 6)), *((rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40))]


@pytest.mark.parametrize("short", [C.SHORT, 10])
def test_components_of_short_and_long_tables(spark, monkeypatch, short):
    monkeypatch.setattr(C, "SHORT", short)
    got = C.components(spark.createDataFrame(edges(), "u long, v long")).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["component"] for r in got} == by_search(edges())
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_short_tables_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "_least", None)
    assert {tuple(r) for r in C.components(spark.createDataFrame([(3, 2), (2, 9)], "u long, v long")).collect()} == {(2, 2), (3, 2), (9, 2)}
