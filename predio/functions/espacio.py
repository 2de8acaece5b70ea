"""Plane and spherical geometry on rings of (lon, lat), as columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

METROS_POR_GRADO = 111_320.0


def distancia(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between near points, at their mean latitude."""
    media = F.radians((lat1 + lat2) / 2)
    return F.hypot((lon2 - lon1) * METROS_POR_GRADO * F.cos(media), (lat2 - lat1) * METROS_POR_GRADO)


def _lados(anillo: Column, valor: Callable[[Column, Column], Column]) -> Column:
    """Sum over a ring's sides of a value of their two ends."""
    n = F.size(anillo)
    cada = F.transform(anillo, lambda p, i: valor(p, F.get(anillo, (i + 1) % n)))
    return F.aggregate(cada, F.lit(0.0), lambda total, v: total + v)


def area(anillo: Column) -> Column:
    """Area of a ring of points with x and y, in their unit squared; 0 for fewer than three."""
    return F.when(F.size(anillo) < 3, 0.0).otherwise(F.abs(_lados(anillo, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2)


def contiene(anillo: Column, x: Column, y: Column) -> Column:
    """Even-odd rule, edges half open."""

    def cruza(a: Column, b: Column) -> Column:
        corte = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < corte), 1.0).otherwise(0.0)

    return _lados(anillo, cruza) % 2 == 1


def rumbo_y_distancia(dx: Column, dy: Column, dz: Column) -> Column:
    """Azimuth, elevation and distance of a point seen from another; straight down if they agree."""
    plano = F.hypot(dx, dy)
    d = F.sqrt(dx * dx + dy * dy + dz * dz)
    cerca = d < 1e-6
    return F.struct(
        F.when(cerca, 0.0).otherwise(F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))).alias("azimut"),
        F.when(cerca, -90.0).otherwise(F.degrees(F.atan2(dz, plano))).alias("elevacion"),
        F.when(cerca, 0.0).otherwise(d).alias("distancia"),
    )


def media_circular(grados: Column) -> Column:
    """Aggregate: mean direction in degrees, 0 to 360."""
    r = F.radians(grados)
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(r)), F.sum(F.cos(r)))), F.lit(360.0))


def _con(valor: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(valor), f), F.lit(0))


def _signada(anillo: Column) -> Column:
    """Area with the sign of the ring's turn: above 0 counter-clockwise."""
    return _lados(anillo, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def _punto(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def recortar(anillo: Column, planos: Column) -> Column:
    """The part of a ring inside all half planes (array of a, b, c: a x + b y + c is not below 0),
    side by side. Each side's result is one variable of a fold, so nothing is computed twice."""

    def lado(p: Column, h: Column) -> Column:
        return h["a"] * p["x"] + h["b"] * p["y"] + h["c"]

    def corte(p: Column, q: Column, h: Column) -> Column:
        t = F.try_divide(lado(p, h), lado(p, h) - lado(q, h))
        return _punto(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))

    def por_plano(queda: Column, h: Column) -> Column:
        n = F.size(queda)

        def paso(p: Column, i: Column) -> Column:
            previo = F.get(queda, (i + n - 1) % n)
            dentro, antes = lado(p, h) >= 0, lado(previo, h) >= 0
            return F.when(dentro & antes, F.array(p)).when(dentro, F.array(corte(previo, p, h), p)).when(antes, F.array(corte(previo, p, h))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

        return F.flatten(F.transform(queda, paso))

    return F.aggregate(planos, F.transform(anillo, lambda p: _punto(p["x"], p["y"])), por_plano)


def rectangulo(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Half planes of an upright rectangle."""
    h = lambda a, b, c: F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), c.cast("double").alias("c"))
    return F.array(h(1, 0, -x0), h(-1, 0, x1), h(0, 1, -y0), h(0, -1, y1))


def lados_convexos(anillo: Column) -> Column:
    """Half planes of a convex ring, whichever way it turns."""

    def con_giro(giro: Column) -> Column:
        n = F.size(anillo)

        def plano(p: Column, i: Column) -> Column:
            q = F.get(anillo, (i + 1) % n)
            a, b = giro * (p["y"] - q["y"]), giro * (q["x"] - p["x"])
            return F.struct(a.alias("a"), b.alias("b"), (-(a * p["x"] + b * p["y"])).alias("c"))

        return F.transform(anillo, plano)

    return _con(F.signum(_signada(anillo)), con_giro)


def _abanico(anillo: Column) -> Column:
    """A ring as signed triangles from its first corner: array of (t, s); together they cover it once."""
    p = lambda i: F.get(anillo, i)
    triangulo = lambda i: _con(F.array(p(F.lit(0)), p(i), p(i + 1)), lambda t: F.struct(t.alias("t"), F.signum(_signada(t)).alias("s")))
    hay = F.size(anillo) >= 3
    return F.when(hay, F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(anillo) - 2, F.lit(1))), triangulo), lambda t: t["s"] != 0)).otherwise(F.array().cast("array<struct<t:array<struct<x:double,y:double>>,s:double>>"))


def es_convexo(anillo: Column) -> Column:
    """Whether a simple ring with an area turns one way only."""
    n = F.size(anillo)

    def giro(p: Column, i: Column) -> Column:
        q, r = F.get(anillo, (i + 1) % n), F.get(anillo, (i + 2) % n)
        return (q["x"] - p["x"]) * (r["y"] - q["y"]) - (q["y"] - p["y"]) * (r["x"] - q["x"])

    giros = lambda g: F.forall(g, lambda v: v >= 0) | F.forall(g, lambda v: v <= 0)
    return F.when((n >= 3) & (_signada(anillo) != 0), _con(F.transform(anillo, giro), giros)).otherwise(False)


def traslape(a: Column, b: Column) -> Column:
    """Area that two simple rings share: one clipped by the other if that is convex, else the signed sum over
    the triangles of both."""

    def con(ta: Column, tb: Column) -> Column:
        planos = F.transform(tb, lambda t: F.struct(lados_convexos(t["t"]).alias("h"), t["s"].alias("s")))
        par = lambda t, planos: F.aggregate(planos, F.lit(0.0), lambda suma, h: suma + t["s"] * h["s"] * _con(recortar(t["t"], h["h"]), area))
        return _con(planos, lambda h: F.aggregate(ta, F.lit(0.0), lambda suma, t: suma + par(t, h)))

    de = lambda x, y: _con(recortar(x, lados_convexos(y)), area)
    triangulos = F.abs(_con(F.struct(_abanico(a).alias("a"), _abanico(b).alias("b")), lambda x: con(x["a"], x["b"])))
    hay = (F.size(a) >= 3) & (F.size(b) >= 3)
    return F.when(hay & es_convexo(b), de(a, b)).when(hay & es_convexo(a), de(b, a)).when(hay, triangulos).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area; null if both have none."""
    return _con(traslape(a, b), lambda comun: F.try_divide(comun, area(a) + area(b) - comun))


def centroide(anillo: Column) -> Column:
    """Centre of a ring's area; of one without area (fewer than three corners, or flat) the corners' mean."""
    n = F.size(anillo)
    medio = lambda c: F.try_divide(F.aggregate(anillo, F.lit(0.0), lambda s, p: s + p[c]), n)
    # about the first corner: the terms stay small where coordinates are large
    x0, y0 = F.get(anillo, F.lit(0))["x"], F.get(anillo, F.lit(0))["y"]
    cruz = lambda p, q: (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0)
    suma = lambda c, o: _lados(anillo, lambda p, q: (p[c] + q[c] - 2 * o) * cruz(p, q))
    doble = _lados(anillo, cruz)
    centro = lambda d: F.when((n >= 3) & (F.abs(d) > 1e-12), _punto(x0 + suma("x", x0) / (3 * d), y0 + suma("y", y0) / (3 * d))).otherwise(_punto(medio("x"), medio("y")))
    return _con(doble, centro)


def centro_visible(anillo: Column, ancho: Column, alto: Column, margen: float = 40) -> Column:
    """Centre of what a picture shows of a ring inside its margin; null if that has no area."""
    visto = recortar(anillo, rectangulo(F.lit(margen), F.lit(margen), ancho - margen, alto - margen))
    return _con(visto, lambda v: F.when((F.size(v) >= 3) & (area(v) >= 5e-7), centroide(v)))


def _a_lado(x: Column, y: Column, p: Column, q: Column) -> Column:
    """Distance of a point from the side p q."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    t = F.coalesce(F.try_divide((x - p["x"]) * dx + (y - p["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(x - p["x"] - t * dx, y - p["y"] - t * dy)


def a_borde(x: Column, y: Column, anillo: Column) -> Column:
    """Distance of a point from a ring's nearest side."""
    n = F.size(anillo)
    return F.array_min(F.transform(anillo, lambda p, i: _a_lado(x, y, p, F.get(anillo, (i + 1) % n))))


def hausdorff(a: Column, b: Column, partes: int = 20) -> Column:
    """Largest distance from one outline to the other, over the corners and the points that cut each side
    into equal parts, both ways."""

    def densa(anillo: Column) -> Column:
        n = F.size(anillo)
        en = lambda p, q, k: _punto(p["x"] + (q["x"] - p["x"]) * k / partes, p["y"] + (q["y"] - p["y"]) * k / partes)
        return F.flatten(F.transform(anillo, lambda p, i: F.transform(F.sequence(F.lit(0), F.lit(partes - 1)), lambda k: en(p, F.get(anillo, (i + 1) % n), k))))

    lejos = lambda de, otro: F.array_max(F.transform(densa(de), lambda p: a_borde(p["x"], p["y"], otro)))
    return F.greatest(lejos(a, b), lejos(b, a))


def pixel_global(lon: Column, lat: Column, lado: Column) -> Column:
    """Web-Mercator position (x, y) of a point in a world `lado` pixels wide."""
    phi = F.radians(lat)
    return _punto((lon + 180) / 360 * lado, (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * lado)


def coordenada(x: Column, y: Column, lado: Column) -> Column:
    """Longitude (x) and latitude (y) of a Web-Mercator position."""
    return _punto(x / lado * 360 - 180, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / lado)))))
