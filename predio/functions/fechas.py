"""Days and spans of time in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of days and months; the zone whose days count.
DIAS = ("lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo")
MESES = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
ZONA = "America/Santiago"


def de_lista(nombres: tuple[str, ...], n: Column) -> Column:
    """The n-th name, from 1 on."""
    return F.try_element_at(F.array(*map(F.lit, nombres)), n.cast("int"))


def dia_local(ts: Column, zona: str = ZONA) -> Column:
    """Day in a zone of a time without zone, which is in UTC."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zona), ts))


def medianoche_utc(dia: Column, zona: str = ZONA) -> Column:
    """The instant in UTC (without zone) at which a day begins in a zone."""
    return F.convert_timezone(F.lit(zona), F.lit("UTC"), dia.cast("timestamp_ntz"))


def fecha_legible(dia: Column) -> Column:
    return F.concat(F.dayofmonth(dia).cast("string"), F.lit(" de "), de_lista(MESES, F.month(dia)), F.lit(" de "), F.year(dia).cast("string"))


def nombre_del_dia(dia: Column, hoy: Column) -> Column:
    """Today, yesterday, or the day of the week."""
    n = F.datediff(hoy, dia)
    return F.when(n == 0, "Hoy").when(n == 1, "Ayer").otherwise(de_lista(DIAS, F.weekday(dia) + 1))


def duracion(segundos: Column) -> Column:
    """Hours, minutes and seconds."""
    return F.format_string("%d:%02d:%02d", F.floor(segundos / 3600), F.floor(segundos / 60) % 60, segundos % 60)


def _segundos(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a, b)


def parte_restante(desde: Column, hasta: Column, ahora: Column) -> Column:
    """Share of a span that is left, 0 to 1; null if the span is empty."""
    resto = _segundos(ahora, hasta) / F.nullif(_segundos(desde, hasta), F.lit(0))
    return F.when(resto.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), resto)))


def minutos_restantes(hasta: Column, ahora: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(_segundos(ahora, hasta) / 60))


def hace(desde: Column, ahora: Column) -> Column:
    """How long ago, in the largest unit that fits."""
    m = F.floor(_segundos(desde, ahora) / 60)
    return (
        F.when(m < 1, "recién").when(m < 60, F.format_string("hace %d min", m)).when(m < 1440, F.format_string("hace %d h", F.floor(m / 60)))
        .otherwise(F.format_string("hace %d días", F.floor(m / 1440)))
    )
