"""Nearest in time against looking at every row."""

import random

import pytest

from predio.plans import tiempos


@pytest.mark.parametrize("bloque", [3, 50, 10_000])
def test_neighbours_equal_looking_at_all(spark, bloque):
    draw = random.Random(bloque)
    clave = lambda: draw.choice(["a", "a", "a", "a", "b", "c", None])  # noqa: E731  one key has most rows
    izq = [(clave(), draw.choice([None, *range(600)]) if draw.random() < 0.02 else draw.randrange(-50, 600), i) for i in range(300)]
    der = [(draw.choice(["a", "a", "b", "d", None]), draw.randrange(0, 500) // 3 * 3, i) for i in range(200)] + [("a", None, 999)]
    a = spark.createDataFrame(izq, "k string, us long, n int").repartition(4)
    b = spark.createDataFrame(der, "k string, us long, id int").repartition(4)
    cerca = {r.n: (r.cercano, r.lejos) for r in tiempos.mas_cercano(a, b, ["k"], bloque).collect()}
    previo = {r.n: r.previo for r in tiempos.anterior(a, b, ["k"], 20, bloque).collect()}
    assert len(cerca) == len(previo) == len(izq)
    for k, us, n in izq:
        suyas = [(t, i) for q, t, i in der if q is not None and q == k and t is not None and us is not None]
        want = min(((abs(t - us), t > us, i) for t, i in suyas), default=None)
        assert cerca[n] == ((want[2], want[0]) if want else (None, None))
        atras = [(-t, i) for t, i in suyas if 0 <= us - t < 20]
        assert previo[n] == (min(atras)[1] if atras else None)
    assert tiempos.mas_cercano(a, b.where("false"), ["k"], bloque).where("cercano is not null").count() == 0
