"""Greedy rules over drawings against the loop in order; rounds over small and empty tables."""

import random

from predio.plans import planos

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def _lee(df):
    return [r.asDict() for r in df.collect()]


def _en(lote, r):
    return lote["x"] - lote["w"] <= r["px"] < lote["x"] + lote["w"] and lote["y"] - lote["h"] <= r["py"] < lote["y"] + lote["h"]


def _d2(lote, r):
    return (lote["x"] - r["px"]) ** 2 + (lote["y"] - r["py"]) ** 2


def test_labels_to_outlines(spark):
    lotes, rotulos = _lee(planos._lotes(spark, SF)), sorted(_lee(planos._rotulos(spark, SF)), key=lambda r: r["rotulo"])
    numerados = {(a["plano"], a["lote"]) for a in lotes if a["numerado"]}
    libres, want, faltan = {a["lote"]: a for a in lotes if not a["numerado"]}, {}, []
    for r in rotulos:
        if (r["plano"], r["rotulo"]) in numerados:
            continue
        en = [k for k, a in libres.items() if a["plano"] == r["plano"] and _en(a, r)]
        if len(en) == 1:
            want[r["rotulo"]] = (en[0], "contenido")
            del libres[en[0]]
        else:
            faltan.append(r)
    for r in faltan:
        cerca = min(((_d2(a, r), k) for k, a in libres.items() if a["plano"] == r["plano"]), default=(1e9, None))
        if cerca[0] <= 150**2:
            want[r["rotulo"]] = (cerca[1], "cercano")
            del libres[cerca[1]]
    got = planos.rotulo_a_lote(spark, SF).collect()
    assert len(got) == len(want) and {r.rotulo: (r.lote, r.por) for r in got} == want
    assert {p for _, p in want.values()} == {"contenido", "cercano"}


def test_mutual_pairs(spark):
    lotes, rotulos = _lee(planos._lotes(spark, SF)), _lee(planos._rotulos(spark, SF))
    pares = sorted((_d2(a, r), r["rotulo"], a["lote"]) for a in lotes for r in rotulos if a["plano"] == r["plano"] and _d2(a, r) <= 90**2)
    want, usados = {}, set()
    for _, r, a in pares:
        if r not in want and a not in usados:
            want[r] = a
            usados.add(a)
    assert want and {r.rotulo: r.lote for r in planos.parejas_cercanas(spark, SF).collect()} == want


def test_pills_without_clashes(spark):
    kept: list = []
    for p in sorted(_lee(planos._pildoras(spark, SF01)), key=lambda p: (-p["prioridad"], p["id"])):
        if not any(k["plano"] == p["plano"] and abs(k["x"] - p["x"]) < (k["ancho"] + p["ancho"]) / 2 + 2 and abs(k["y"] - p["y"]) < 14 for k in kept):
            kept.append(p)
    got = [r.id for r in planos.rotulos_sin_choques(spark, SF01).collect()]
    assert sorted(got) == sorted(p["id"] for p in kept) and 0 < len(got) < planos._pildoras(spark, SF01).count()


def test_rounds_on_small_and_empty_tables(spark):
    r = random.Random(3)
    aristas = [(a, b) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(25)) if a < b] + [(i, i + 1) for i in range(40, 60)]
    nodos = spark.createDataFrame([(i,) for i in range(61)] + [(3,), (None,)], "id long")
    padre = list(range(61))
    for _ in padre:
        for a, b in aristas:
            padre[a] = padre[b] = min(padre[a], padre[b])
    e = spark.createDataFrame(aristas, "a long, b long")
    assert {x.id: x.grupo for x in planos.componentes(nodos, e).collect()} == dict(enumerate(padre))
    kept: set = set()
    for n in range(61):
        if not any((m, n) in aristas for m in kept):
            kept.add(n)
    assert {x.id for x in planos.conservar(nodos, e.toDF("mejor", "peor")).collect()} == kept
    nada = nodos.where("false")
    assert planos.componentes(nada, e.where("false")).isEmpty() and planos.conservar(nada, e.toDF("mejor", "peor").where("false")).isEmpty()
    pares = spark.createDataFrame([(1, 7, 2.0), (1, 7, 2.0), (2, 7, 2.0), (2, 8, 3.0), (None, 9, 1.0)], "r long, l long, d double")
    assert sorted((x.r, x.l) for x in planos.emparejar(pares, "r", "l", "d").collect()) == [(1, 7), (2, 8)]
    assert planos.emparejar(pares.where("false"), "r", "l", "d").isEmpty()


def test_flights_by_height(spark):
    from predio.plans import miradas

    alturas: dict = {}
    for k in (r.p_partkey for r in spark.read.parquet(f"{SF01}/part.parquet").collect()):
        alturas.setdefault(k // 400, []).append(k * k % 1009)
    want = []
    for plano, todas in alturas.items():
        grupos: list = []
        for a in sorted(set(todas)):
            if not grupos or a * len(grupos[-1]) - sum(grupos[-1]) > 30 * len(grupos[-1]):
                grupos.append([])
            grupos[-1] += [a] * todas.count(a)
        want += [(plano, g[0] / 10, g[-1] / 10, len(g), sum(g) / len(g) / 10) for g in grupos]
    got = [(r.plano, r.desde, r.hasta, r.n, r.media) for r in miradas.vuelos(spark, SF01).collect()]
    assert [g[:4] for g in sorted(got)] == [w[:4] for w in sorted(want)] and all(abs(g[4] - w[4]) < 1e-3 for g, w in zip(sorted(got), sorted(want)))
    assert len(want) > 2 * len(alturas)


def test_rows_are_dealt_before_their_cells_are_listed(spark):
    lotes, rotulos = planos._lotes(spark, SF), planos._rotulos(spark, SF)
    for df in (planos.dentro(lotes, rotulos), planos.cercanos(lotes, rotulos, 90), planos.chocan(planos._pildoras(spark, SF), 2, 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        listadas = plan[: plan.rindex("REPARTITION_BY_NUM")]
        assert "Generate explode" in listadas  # above the deal, not below it in the file's one task
