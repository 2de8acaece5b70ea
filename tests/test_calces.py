"""Stages by elimination and anchors against loops that do one project or plan after another."""

import cmath
import random
import re
import statistics
from collections import Counter

import pytest

from predio.plans import calces


def a_mano(fichas, ids):
    """fichas: (id, numero, etapa); ids: names of the drawing. id -> (drawing's id, how)."""
    propios = {f[0] for f in fichas}
    pendientes, libres = [f for f in fichas if f[0] not in ids], set(ids) - propios
    veces = Counter(f[1] for f in pendientes)
    nuevos = {f[0]: (f[1], "numero") for f in pendientes if f[1] in libres and veces[f[1]] == 1}
    libres -= {n for n, _ in nuevos.values()}
    etapas, grupos = {}, {}
    for i, n, e in pendientes:
        if i not in nuevos and n and e is not None:
            etapas.setdefault(e, {})[n] = i
    for r in libres:
        m = re.fullmatch(r"(.*?)(\d*)", r)
        grupos.setdefault(m[1], {})[m[2]] = r
    while True:
        firmes = {}
        for p in sorted(grupos):
            caben = [e for e in etapas if sum(n in etapas[e] for n in grupos[p]) >= 0.9 * len(grupos[p])]
            if len(caben) == 1:
                firmes.setdefault(caben[0], p)
        if not firmes:
            break
        for e, p in firmes.items():
            nuevos |= {etapas[e][n]: (r, "descarte") for n, r in grupos[p].items() if n in etapas[e]}
            del grupos[p], etapas[e]
    return {f[0]: nuevos.get(f[0], (f[0], "igual" if f[0] in ids else None)) for f in fichas}


def casos():
    n = lambda e, k: [(f"{e}-{i}", str(i), e) for i in range(1, k + 1)]
    quillon = n(1, 17) + n(2, 26) + n(3, 32) + [("3-B1", "B1", 3)]
    yield quillon, {str(i) for i in range(1, 18)} | {f"2-{i}" for i in range(1, 27)} | {f"A{i}" for i in range(1, 33)}
    yield [("1-A1", "A1", 1), ("1-A2", "A2", 1), ("2-A300", "A300", 2)], {"A1", "A2", "A300", "A301"}
    yield [("1-7", "7", 1), ("2-7", "7", 2)], {"7"}
    yield [("1-7", "7", 1), ("2-7", "7", 2)], {"1-7", "2-7"}
    yield [("A1", "A1", None)], {"A1"}
    yield n(1, 20) + n(2, 20), {f"x{i}" for i in range(1, 21)} | {f"y{i}" for i in range(1, 21)}  # ambiguous
    yield n(1, 10) + n(2, 20), {f"x{i}" for i in range(1, 11)} | {f"y{i}" for i in range(1, 21)} | {"RESTO"}
    yield n(1, 20), {f"x{i}" for i in range(1, 20)} | {"x99"} | {f"z{i}" for i in range(1, 11)}  # two groups, one stage
    draw = random.Random(6)
    for _ in range(8):
        fichas = [f for e in range(1, draw.randint(2, 5)) for f in n(e, draw.randint(1, 30)) if draw.random() < 0.95]
        yield fichas, {f"{draw.choice(['', 'A', 'b-', '2-', str(f[2]) + '-'])}{f[1]}" if draw.random() < 0.1 else f"{'xyzwv'[f[2]]}{f[1]}" for f in fichas if draw.random() < 0.97}


def test_stages_by_elimination(spark):
    todos = list(casos())
    fichas = spark.createDataFrame([(g, *f) for g, (fs, _) in enumerate(todos) for f in fs], "grupo int, id string, numero string, etapa int").repartition(3)
    ids = spark.createDataFrame([(g, i) for g, (_, ids) in enumerate(todos) for i in ids], "grupo int, id string").repartition(3)
    got = {}
    for r in calces.alinear(fichas, ids).collect():
        got.setdefault(r.grupo, {})[r.id] = (r.id_dibujo, r.por)
    for g, (fs, ids_) in enumerate(todos):
        assert got[g] == a_mano(fs, ids_), g
    assert {x for v in got.values() for x in v.values() if x[1] == "descarte"} and got[0]["3-7"] == ("A7", "descarte") and got[0]["1-7"] == ("7", "descarte")
    nada = fichas.where("false")
    assert calces.alinear(nada, ids).count() == 0 and calces.alinear(fichas, ids.where("false")).where("por is not null").count() == 0


def ajuste(ps):
    z, w = [complex(x, -y) for x, y, _, _ in ps], [complex(e, n) for _, _, e, n in ps]
    zm, wm = sum(z) / len(z), sum(w) / len(w)
    a = sum((p - zm).conjugate() * (q - wm) for p, q in zip(z, w)) / sum(abs(p - zm) ** 2 for p in z)
    return a, wm - a * zm


def resto(p, a, b):
    return abs(complex(p[2], p[3]) - (a * complex(p[0], -p[1]) + b))


def sin_una(ps, i):
    otras = [p for j, p in enumerate(ps) if j != i]
    a, b = ajuste(otras)
    d = [resto(p, a, b) for p in otras]
    return resto(ps[i], a, b), max(3 * statistics.median(d), 4.0), (sum(x * x for x in d) / len(d)) ** 0.5


def plan_a_mano(ps):
    a, b = ajuste(ps)
    n, raras = len(ps), set()
    loo = [sin_una(ps, i) for i in range(n)] if n >= 3 else [(None, None, None)] * n
    if n == 3:
        raras = {i for i, x in enumerate(loo) if x[0] > x[1]}
    vivas = list(range(n))
    while n >= 4 and len(vivas) >= 4:
        cada = [sin_una([ps[j] for j in vivas], i) for i in range(len(vivas))]
        k = min(range(len(vivas)), key=lambda i: (round(cada[i][2], 9), i))
        if cada[k][0] <= cada[k][1]:
            break
        raras.add(vivas.pop(k))
    control = "sin control" if n == 2 else "inconsistente" if n == 3 and raras else "atipicas" if raras else "ok"
    return [(resto(p, a, b), loo[i][0], i in raras, abs(a), cmath.phase(a), control) for i, p in enumerate(ps)]


def test_anchors_equal_refitting(spark):
    draw = random.Random(9)
    planos = {}
    for k in range(40):
        n = draw.choice([2, 3, 3, 4, 5, 12])
        a = cmath.rect(draw.uniform(0.1, 3), draw.uniform(-3, 3))
        ps = []
        for _ in range(n):
            x, y = draw.uniform(0, 4000), draw.uniform(0, 3000)
            w = a * complex(x, -y) + complex(300_000, 6_100_000) + complex(draw.gauss(0, 1), draw.gauss(0, 1)) + (draw.random() < 0.2) * complex(draw.choice([-150, 80]), 60)
            ps.append((x, y, w.real, w.imag))
        planos[k] = ps
    filas = [(k, i, *p) for k, ps in planos.items() for i, p in enumerate(ps)] + [(100, 0, 1.0, 1.0, 5.0, 5.0), (101, 0, 1.0, 1.0, 5.0, 5.0), (101, 1, 1.0, 1.0, 6.0, 5.0), (102, 0, None, 1.0, 5.0, 5.0)]
    got = {(r.plano, r.punto): r for r in calces.por_anclas(spark.createDataFrame(filas, "plano int, punto int, x double, y double, este double, norte double").repartition(4)).collect()}
    for k, ps in planos.items():
        for i, (res, loo, rara, escala, giro, control) in enumerate(plan_a_mano(ps)):
            r = got[k, i]
            assert (r.residuo, r.escala) == pytest.approx((res, escala), abs=1e-5) and (r.atipica, r.control) == (rara, control), (k, i)
            assert r.residuo_sin_ella == (pytest.approx(loo, abs=1e-5) if loo is not None else None)
            assert abs((r.giro - giro * 57.29577951308232 + 180) % 360 - 180) < 1e-6
    assert {"inconsistente", "atipicas", "ok", "sin control"} <= {r.control for r in got.values()}
    assert sum(r.atipica for r in got.values()) > 10 and got[100, 0].control is None and got[101, 1].control is None and (102, 0) not in got


def test_a_plan_s_sums_cost_one_shuffle(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 0.0)], "plano int, punto int, x double, y double, u double, v double")
    plan = calces.sin_cada_una(p)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert calces.sin_cada_una(p).select("n", "rms", "loo", "sin_ar", "sin_br").first()[:] == (1, None, None, None, None)
