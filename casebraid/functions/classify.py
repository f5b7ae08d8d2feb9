"""Classification of activity sentences and requests, and what is read out of them (CLS-01..12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Task code, group and pattern, in the order they are tried; the first match wins.
PATTERNS = [
    ("GERACAO-PROCEDIMENTO", "abertura", r"^Processo\b.*\bgerado"),
    ("PROCESSO-ATRIBUIDO", "abertura", r"^Processo atribuído"),
    ("PROCESSO-DESATRIBUIDO", "abertura", r"^Removida atribuição"),
    ("PROCESSO-REMETIDO-UNIDADE", "tramitacao", r"^Processo remetido"),
    ("PROCESSO-RECEBIDO-UNIDADE", "tramitacao", r"^Processo recebido"),
    ("CONCLUSAO-PROCESSO-UNIDADE", "tramitacao", r"^Conclusão do processo|^Processo concluído"),
    ("CONCLUSAO-AUTOMATICA-UNIDADE", "automatico", r"^Conclusão automática"),
    ("REABERTURA-PROCESSO-UNIDADE", "tramitacao", r"^Reabertura do processo"),
    ("SOBRESTAMENTO", "tramitacao", r"^Sobrest(?:ado|amento|ando)"),
    ("REMOCAO-SOBRESTAMENTO", "tramitacao", r"^Remoção de sobrestamento"),
    ("ASSINATURA-DOCUMENTO", "assinatura", r"^Assinado Documento"),
    ("AUTENTICACAO-DOCUMENTO", "assinatura", r"^Autenticado Documento"),
    ("CANCELAMENTO-ASSINATURA", "assinatura", r"^Cancelamento de assinatura"),
    ("CANCELAMENTO-LIBERACAO-ASSINATURA", "assinatura", r"^Cancelada liberação de assinatura"),
    ("LIBERACAO-ASSINATURA-EXTERNA", "assinatura", r"^Liber(?:ação|ada)\b.*assinatura externa"),
    ("DOCUMENTO-CIENCIA", "assinatura", r"^Ciência no documento"),
    ("PROCESSO-CIENCIA", "assinatura", r"^Ciência no processo"),
    ("GERACAO-DOCUMENTO", "criacao", r"^Gerado documento|^Documento.*gerado"),
    ("ARQUIVO-ANEXADO", "criacao", r"^Arquivo.*anexado"),
    ("PROCESSO-ANEXADO", "edicao", r"^Processo\b.*\banexado|^Anexado ao processo"),
    ("DOCUMENTO-MOVIDO", "edicao", r"^Documento\b.*\bmovido"),
    ("RECEBIMENTO-DOCUMENTO", "criacao", r"^Registro de documento externo"),
    ("DOCUMENTO-INCLUIDO-EM-BLOCO", "blocos", r"^Documento.*inserido no bloco"),
    ("DOCUMENTO-RETIRADO-DO-BLOCO", "blocos", r"^Documento.*retirado do bloco"),
    ("PROCESSO-INCLUIDO-EM-BLOCO", "blocos", r"^Processo inserido no bloco"),
    ("PROCESSO-RETIRADO-DO-BLOCO", "blocos", r"^Processo retirado do bloco"),
    ("BLOCO-DISPONIBILIZACAO", "blocos", r"^Disponibilização do bloco|^Bloco\b.*\bdisponibilizado"),
    ("BLOCO-RETORNO", "blocos", r"^Retorno do bloco|^Bloco\b.*\bretornado"),
    ("BLOCO-CONCLUSAO", "blocos", r"^Conclusão do bloco"),
    ("BLOCO-REABERTURA", "blocos", r"^Reabertura do bloco"),
    ("BLOCO-CANCELAMENTO-DISPONIBILIZACAO", "blocos", r"Cancel.*disponibilização.*bloco|Cancel.*disponibilização do bloco"),
    ("REMOCAO-ANEXO", "edicao", r"^Anexo\b.*removido do documento"),
    ("CANCELAMENTO-DOCUMENTO", "edicao", r"^Cancel(?:amento|ado)\b.*documento"),
    ("EXCLUSAO-DOCUMENTO", "edicao", r"^Exclusão do documento"),
    ("ALTERACAO-NIVEL-ACESSO-DOCUMENTO", "edicao", r"^Alter(?:ação|ado)\b.*nível de acesso.*documento"),
    ("ALTERACAO-NIVEL-ACESSO-PROCESSO", "edicao", r"^Alter(?:ação|ado)\b.*nível de acesso.*(?:processo|geral)"),
    ("ALTERACAO-TIPO-PROCESSO", "edicao", r"^Alter(?:ação|ado)\b.*tipo d[oe] processo"),
    ("ALTERACAO-HIPOTESE-LEGAL", "edicao", r"^Alter(?:ação|ada|ado)\b.*hipótese legal"),
    ("ALTERACAO-TIPO-CONFERENCIA", "edicao", r"^Alter(?:ação|ado)\b.*tipo de conferência"),
    ("PROCESSO-ALTERACAO-ORDEM-ARVORE", "edicao", r"^Alter(?:ação|ada)\b.*ordem"),
    ("ATUALIZACAO-ANDAMENTO", "edicao", r"^Atualização de andamento"),
    ("ACESSO-EXTERNO-SISTEMA", "comunicacao", r"^Disponibilizado acesso externo"),
    ("CANCELAMENTO-ACESSO-EXTERNO", "comunicacao", r"Cancel.*disponibilização.*acesso externo"),
    ("ENVIO-EMAIL", "comunicacao", r"^Enviado e-mail|^Envio de e-mail|^Envio de correspond"),
    ("PETICIONAMENTO-EXTERNO", "comunicacao", r"Usu[aá]rio Externo.*Peticionamento"),
    ("CREDENCIAL-CONCEDIDA", "comunicacao", r"^Credencial concedida"),
]
# Fixed value: the one pattern that minds case.
GENERIC = ("DESCRICAO-GENERICA", "outros", r"^@DESCRICAO@$")
# Hours of work that an activity of a group stands for.
GROUP_HOURS = {"criacao": 0.5, "assinatura": 0.0, "tramitacao": 1.0, "blocos": 0.0, "edicao": 0.0, "abertura": 0.0, "comunicacao": 0.0, "automatico": 0.0, "outros": 0.0}


def task_code(text: Column) -> Column:
    """CLS-01: the code of the first pattern found in the text, else OUTROS. Letters of any alphabet fold their case."""
    out = None
    for code, _, pattern in PATTERNS:
        hit = text.rlike(f"(?iuU){pattern}")
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.when(text.rlike(GENERIC[2]), GENERIC[0]).otherwise("OUTROS")


def task_groups(spark: SparkSession) -> DataFrame:
    """CLS-02, CLS-08: tipo, grupo and horas of every code: a dimension of 48 rows."""
    rows = [(code, group, GROUP_HOURS[group]) for code, group, _ in [*PATTERNS, GENERIC]] + [("OUTROS", "outros", GROUP_HOURS["outros"])]
    return spark.createDataFrame(rows, "tipo string, grupo string, horas double")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def source_unit(text: Column, code: Column) -> Column:
    """CLS-03, only of sent activities."""
    return F.when(code == "PROCESSO-REMETIDO-UNIDADE", _found(text, r"(?iuU)remetido pela unidade (\S+)"))


def document(text: Column) -> Column:
    """CLS-04: numero, tipo and serie_id of a document named like 1234567 (Ofício 12); null without one."""
    pattern = r"(\d{7,})\s*\(([^)\d]*?)(?:\s+(\d+))?\)"
    number = _found(text, pattern)
    return F.when(number.isNotNull(), F.struct(number.alias("numero"), F.nullif(F.trim(F.regexp_extract(text, pattern, 2)), F.lit("")).alias("tipo"), _found(text, pattern, 3).alias("serie_id")))


def reference(text: Column) -> Column:
    """CLS-05: bloco:N before doc:N."""
    return F.coalesce(F.concat(F.lit("bloco:"), _found(text, r"(?iuU)bloco\s+(\d+)")), F.concat(F.lit("doc:"), _found(text, r"(\d{7,})")))


def organ(unit: Column) -> Column:
    """CLS-06: the first part of a unit's path; DESCONHECIDO without one."""
    return F.when(F.coalesce(unit, F.lit("")) == "", "DESCONHECIDO").otherwise(F.split_part(unit, F.lit("/"), F.lit(1)))


def ancestors(unit: Column) -> Column:
    """CLS-07: the paths above a unit, from the top down."""
    parts = F.split(unit, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


#: Where the tiers of similarity begin.
TIERS = (0.40, 0.80, 0.90)


def similarity_tier(score: Column) -> Column:
    """CLS-11, on the unrounded score."""
    return F.when(score >= 0.90, "very_high").when(score >= 0.80, "high").when(score >= 0.40, "medium").otherwise("low")
