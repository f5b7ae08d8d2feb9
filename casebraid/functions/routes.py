"""What a request's path tells (CLS-09), and what a file's name tells (CLS-12, STR-16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of paths, in the order in which they are tried, and the activity each stands for.
ROUTES = [
    ("^/auth/", "login"),
    ("^/sei-proxy/login", "login"),
    ("^/processo/[^/]+/andamentos", "visualizar_processo"),
    ("^/processo/[^/]+/documentos", "visualizar_documento"),
    ("^/processo/[^/]+/resumo", "gerar_resumo"),
    ("^/processo/", "visualizar_processo"),
    ("^/historico", "pesquisar_processo"),
    ("^/observacoes", "criar_observacao"),
    ("^/fluxos", "fluxo"),
    ("^/compartilhamentos", "compartilhar"),
    ("^/equipes", "equipe"),
    ("^/tags", "tag"),
    ("^/admin/", "admin_action"),
    ("^/d1/", "consulta_d1"),
]


def activity(path: Column) -> Column:
    """CLS-09: the first route that fits; others are outro."""
    return F.coalesce(*(F.when(path.rlike(pattern), F.lit(kind)) for pattern, kind in ROUTES), F.lit("outro"))


def resource(path: Column) -> Column:
    """CLS-09: what follows /processo/, /fluxos/ or /equipes/; else null."""
    return F.nullif(F.regexp_extract(path, "^/(?:processo|fluxos|equipes)/([^/]+)", 1), F.lit(""))


def file_name(header: Column) -> Column:
    """STR-16: the name in a header's filename="..."; else null."""
    return F.nullif(F.regexp_extract(header, 'filename="(.+)"', 1), F.lit(""))


def without_prefix(name: Column) -> Column:
    """STR-09: what follows the first ' - ', or else the first point."""
    after = lambda sep: F.trim(F.substring(name, F.locate(sep, name) + F.lit(len(sep)), F.length(name)))
    return F.when(name.contains(" - "), after(" - ")).when(name.contains("."), after(".")).otherwise(name)
