"""Every query of the analytics side: name to Spark query, and name to DuckDB SQL."""

from __future__ import annotations

from predio.plans import actividad, calces, consola, dibujos, escalares, estadisticas, filtros, inventario, lecturas, medidas, miradas, planillas, planos, publicacion, recortes, terreno, tiempos, visor
from predio.streaming import apartados, continuas

MODULES = (estadisticas, filtros, inventario, actividad, medidas, consola, dibujos, escalares, planillas, visor, planos, miradas, publicacion, dibujos, recortes, calces, tiempos, terreno, lecturas, filtros, continuas, apartados)

QUERIES: dict = {}
ORACLES: dict = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
