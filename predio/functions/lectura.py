"""Reading tables and coordinates from written text, where a piece belongs to what stood before it.

The rows of a table of surfaces need at most four lines back, so each line looks at those instead of
carrying a state through the text; coordinates are a fold over their few pieces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from predio.functions.espacio import _con

#: The forms of a row's lot, of a cell with its unit, and of a surface.
LOTE_FILA = r"^\D*?(\d{1,3}(?:-\d{1,3})?)(?![\d.,])"
CELDA = r"(?iuU)(\d+(?:[.,]\d+)*)(\s?(?:m2|m²|mts?2|h[aá]s?\b|hect\w*))?"
AREA = r"^(?:\d{1,3}(?:\.\d{3})*,\d{1,2}|\d{1,3}(?:\.\d{3})+|\d{4,7})$"
RESTO = r"(?iuU)\bresto\b"
HECTAREAS, METROS = r"(?iuU)h[aá]s?\b|hect", r"(?i)m2|m²|mt2|mts2"
#: Lines without digits that may stand between a lot's number and its cells.
ENTRE = 3


def valor(x: Column) -> Column:
    """The first number in a text, points for thousands and a comma for decimals; a single point that groups no
    thousands is a decimal one; null if there is none or its signs contradict each other."""
    t = F.regexp_extract(F.coalesce(x, F.lit("")), r"(\d+(?:[.,]\d+)*)", 1)
    comas, puntos = F.length(F.regexp_replace(t, "[^,]", "")), F.length(F.regexp_replace(t, "[^.]", ""))
    miles = t.rlike(r"^\d{1,3}(\.\d{3})+$")
    limpio = (
        F.when((comas > 0) & (puntos > 0), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comas == 1, F.replace(t, F.lit(","), F.lit("."))).when(comas > 1, F.lit(None))
        .when(miles, F.replace(t, F.lit("."), F.lit(""))).when(puntos > 1, F.lit(None)).otherwise(t)
    )
    return limpio.try_cast("double")


def area_m2(x: Column, unidad: Column | None = None) -> Column:
    """Square metres of a written surface: the unit is the text's, or `unidad` ('ha', 'm2'), or by size: below 100 hectares."""
    v = valor(x)
    dicha = F.when(x.rlike(HECTAREAS), "ha").when(x.rlike(METROS), "m2")
    otra = F.when(v < 100, "ha").otherwise("m2")
    u = F.coalesce(dicha, otra if unidad is None else F.coalesce(unidad, otra))
    return F.when(v > 0, F.round(F.when(u == "ha", v * 10000).otherwise(v), 2))


def lineas_cuadro(texto: Column) -> Column:
    """What each line of a text is: array of k ('F' row, 'S' lot alone, 'A' cells without a lot, 'D' no digits,
    'X' other), lote, celdas, resto."""

    def leer(linea: Column) -> Column:
        entero = F.regexp_extract(linea, LOTE_FILA, 0)
        lote = F.regexp_extract(linea, LOTE_FILA, 1)
        con_lote = (lote != "") & F.regexp_extract(lote, r"(\d+)$", 1).rlike("[1-9]")
        desde = F.when(con_lote, F.substring(linea, F.length(entero) + 1, F.length(linea))).otherwise(linea)
        celdas = F.transform(F.regexp_extract_all(desde, F.lit(CELDA), 0), lambda c: F.trim(c))
        ultima = F.regexp_extract(F.element_at(celdas, -1), CELDA, 1)
        con_area = F.when(F.size(celdas) > 0, ultima.rlike(AREA)).otherwise(False)
        solo = con_lote & (F.regexp_replace(desde, "[ .:]", "") == "")
        k = F.when(con_lote & con_area, "F").when(solo, "S").when(con_area, "A").when(~linea.rlike(r"(?U)\d"), "D").otherwise("X")
        return F.struct(k.alias("k"), F.when(con_lote, lote).alias("lote"), celdas.alias("celdas"), linea.rlike(RESTO).alias("resto"))

    return F.transform(F.split(F.coalesce(texto, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085  ]"), leer)


def filas_cuadro(lineas: Column) -> Column:
    """Rows (lote, celdas) of a table of surfaces, from the column of its lineas_cuadro(): a line that begins with a lot and ends
    with a surface, or one that ends with a surface below a lot alone (up to three lines without digits
    between), or one that says "resto"."""

    def fila(l: Column, i: Column) -> Column:  # noqa: E741
        antes = lambda n: F.get(lineas, i - n)
        suyo, libre = F.when(antes(1)["k"] == "S", antes(1)["lote"]), antes(1)["k"] == "D"
        for n in range(2, ENTRE + 2):
            suyo = F.coalesce(suyo, F.when(libre & (antes(n)["k"] == "S"), antes(n)["lote"]))
            libre = libre & (antes(n)["k"] == "D")
        lote = F.when(l["k"] == "F", l["lote"]).when(l["k"] == "A", F.coalesce(suyo, F.when(l["resto"], "Resto")))
        return F.struct(lote.alias("lote"), l["celdas"].alias("celdas"))

    return F.filter(F.transform(lineas, fila), lambda f: f["lote"].isNotNull())


def clave_lote(x: Column) -> Column:
    """A lot's number without leading zeros in its parts."""
    return F.array_join(F.transform(F.split(x, "-"), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")), "-")


_PIEZA = r"([+-]?\d+(?:\.\d+)?\s*[°'\"]?|[NSEWO]|[,;]|\S)"
_NADA = "struct<numeros:array<struct<t:string,u:string>>,h:string>"


def _normal(x: Column) -> Column:
    t = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    for de, a in (("[º˚]", "°"), ("[′’‘´`]", "'"), ("[″”“]", '"'), ("''", '"'), (r"(\d),(\d+)(?=\s*[°'\"])", "$1.$2")):
        t = F.regexp_replace(t, de, a)
    par = r"^([+-]?\d+),(\d+)(?:\s*;\s*|\s+)([+-]?\d+),(\d+)$"
    return _con(t, lambda t: F.when(~t.contains(".") & t.rlike(par), F.regexp_replace(t, par, "$1.$2 $3.$4")).otherwise(t))


def _partes(piezas: Column) -> Column:
    """The pieces as coordinates: each has numbers with their signs and at most one hemisphere, before or behind them."""
    vacia = F.struct(F.array().cast("array<struct<t:string,u:string>>").alias("numeros"), F.lit(None).cast("string").alias("h"))
    inicio = F.struct(F.array().cast(f"array<{_NADA}>").alias("hechas"), vacia.alias("a"))
    orden = lambda u: F.when(u == "'", 1).when(u == '"', 2).otherwise(0)

    def cerrada(s: Column) -> Column:
        hay = (F.size(s["a"]["numeros"]) > 0) | s["a"]["h"].isNotNull()
        return F.when(hay, F.concat(s["hechas"], F.array(s["a"]))).otherwise(s["hechas"])

    def paso(s: Column, p: Column) -> Column:
        a, n = s["a"], F.size(s["a"]["numeros"])
        unidad = F.regexp_extract(p, "([°'\"])$", 1)
        numero = F.struct(F.regexp_extract(p, r"^([+-]?\d+(?:\.\d+)?)", 1).alias("t"), unidad.alias("u"))
        previa = F.get(a["numeros"], n - 1)["u"]
        otra = (n > 0) & ((unidad == "") | (unidad == "°") | (orden(unidad) <= orden(previa)))
        con = lambda hechas, numeros, h: F.struct(hechas.alias("hechas"), F.struct(numeros.alias("numeros"), h.alias("h")).alias("a"))
        sin = F.array().cast("array<struct<t:string,u:string>>")
        nada = F.lit(None).cast("string")
        detras = F.concat(s["hechas"], F.array(F.struct(a["numeros"].alias("numeros"), p.alias("h"))))
        return (
            F.when(p.isin(",", ";"), F.when(n > 0, con(cerrada(s), sin, nada)).otherwise(s))
            .when(p.rlike("^[NSEWO]$"), F.when((n > 0) & a["h"].isNull(), con(detras, sin, nada)).otherwise(con(cerrada(s), sin, p)))
            .when(otra, con(cerrada(s), F.array(numero), nada)).otherwise(con(s["hechas"], F.concat(a["numeros"], F.array(numero)), a["h"]))
        )

    return F.aggregate(piezas, inicio, paso, cerrada)


def _grados(c: Column) -> Column:
    """Degrees and axis of one coordinate; null if its numbers don't go together."""
    ns = c["numeros"]
    n = F.size(ns)
    orden = lambda i: F.when(F.get(ns, i)["u"] == "'", 1).when(F.get(ns, i)["u"] == '"', 2).when((F.get(ns, i)["u"] == "°") | (i == 0), 0)
    v = lambda i: F.abs(F.get(ns, i)["t"].cast("double"))
    bien = F.forall(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(
        orden(i).isNotNull() & ((i == 0) | ((orden(i) > orden(i - 1)) & ~F.get(ns, i)["t"].rlike("^[+-]"))) & ((i == n - 1) | (v(i) == F.floor(v(i)))) & ((orden(i) == 0) | (v(i) < 60)), F.lit(False)))
    total = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda s, i: s + v(i) / F.pow(F.lit(60.0), orden(i)))
    menos = F.get(ns, F.lit(0))["t"].startswith("-")
    sur = c["h"].isin("S", "W", "O")
    contra = F.coalesce(menos & ~sur, F.lit(False))
    signo = F.when(c["h"].isNull(), F.when(menos, -1).otherwise(1)).when(sur, -1).otherwise(1)
    eje = F.when(c["h"].isin("N", "S"), "lat").when(c["h"].isNotNull(), "lon")
    return F.when((n > 0) & bien & ~contra, F.struct((signo * total).alias("valor"), eje.alias("eje")))


def coordenadas(x: Column) -> Column:
    """struct<lat, lon> of a written pair: decimal degrees, or degrees, minutes and seconds, with or without hemispheres, which
    then say which is which; without them latitude comes first, unless only the other way is possible. Null if it isn't one."""

    def juzgar(cs: Column) -> Column:
        a, b = F.get(cs, F.lit(0)), F.get(cs, F.lit(1))
        igual = F.coalesce(a["eje"] == b["eje"], F.lit(False))
        vuelta = F.coalesce(a["eje"] == "lon", F.lit(False)) | F.coalesce(b["eje"] == "lat", F.lit(False))
        sin = a["eje"].isNull() & b["eje"].isNull() & (F.abs(a["valor"]) > 90) & (F.abs(b["valor"]) <= 90)
        lat, lon = F.when(vuelta | sin, b["valor"]).otherwise(a["valor"]), F.when(vuelta | sin, a["valor"]).otherwise(b["valor"])
        return F.when(a.isNotNull() & b.isNotNull() & ~igual & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.struct(lat.alias("lat"), lon.alias("lon")))

    def leer(piezas: Column) -> Column:
        limpias = F.forall(piezas, lambda p: p.rlike(r"^([+-]?\d+(\.\d+)?\s*[°'\"]?|[NSEWO,;])$"))
        return F.when(limpias, _con(F.transform(_partes(piezas), _grados), lambda cs: F.when(F.size(cs) == 2, juzgar(cs))))

    # a text is taken apart once: what stands in several places of an expression would be computed in each
    return _con(F.transform(F.regexp_extract_all(_normal(x), F.lit(_PIEZA), 0), lambda p: F.trim(p)), leer)
