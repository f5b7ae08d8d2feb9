"""Nodes and edges from the entities and relations of documents (NER-10, NER-11, NER-12), and their removal (SNK-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from .working import Working

# Label of an entity, label of its node, edge from the document, whether the node's key is normalized, and
# the order in which a document's entities are written.
NODES = [
    ("pessoa", "PessoaFisica", "MENCIONA_PESSOA", True, 0),
    ("pessoa_juridica", "PessoaJuridica", "MENCIONA_EMPRESA", True, 1),
    ("orgao", "Orgao", "MENCIONA_ORGAO", False, 2),
    ("cargo", "CargoFuncao", "MENCIONA_CARGO", True, 3),
    ("lei", "Legislacao", "MENCIONA_LEGISLACAO", False, 4),
    ("decreto", "Legislacao", "MENCIONA_LEGISLACAO", False, 5),
    ("portaria", "Legislacao", "MENCIONA_LEGISLACAO", False, 6),
    ("contrato_edital", "ContratoEdital", "MENCIONA_CONTRATO", False, 7),
]
# Relations whose head is the person, and those whose tail is, with their edges.
PERSON_HEAD = {"assinou": "ASSINOU", "autorizou": "AUTORIZOU", "solicitou": "SOLICITOU", "contratou": "CONTRATOU"}
PERSON_TAIL = {"nomeou": "NOMEOU", "designou": "DESIGNOU", "exonerou": "EXONEROU", "encaminhou_para": "ENCAMINHOU_PARA_DOC"}
# Known origins of an entity; any other counts as the first.
ORIGINS = ("gliner", "llm", "hybrid")
#: Entities of a document are written before its relations.
_RELATIONS = 100
EDGES = (*dict.fromkeys(edge for _, _, edge, _, _ in NODES), *PERSON_HEAD.values(), *PERSON_TAIL.values())
LABELS = tuple(node for node in dict.fromkeys(node for _, node, _, _, _ in NODES) if node != "Orgao")


def _case(values: dict, column: str) -> Column:
    out = None
    for key, value in values.items():
        hit = F.col(column) == key
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def mentions(entities: DataFrame) -> DataFrame:
    """Entities (doc_id, label, text, canonical, provenance, place) to doc_id, node, key, nome, edge, fonte, tipo, at.

    The canonical form counts before the text; entities with neither, and labels without a node, are left out. at orders
    the writes: by document, label and place.
    """
    nome = F.coalesce(F.nullif("canonical", F.lit("")), F.nullif("text", F.lit("")))
    known = entities.where(F.col("label").isin(*(n[0] for n in NODES))).withColumn("nome", nome).where("nome is not null")
    key = F.when(_case({n[0]: n[3] for n in NODES}, "label"), normalize(F.col("nome"))).otherwise(F.col("nome"))
    fonte = F.when(F.col("provenance").isin(*ORIGINS), F.col("provenance")).otherwise(ORIGINS[0])
    tipo = F.when(F.col("label").isin("lei", "decreto", "portaria"), F.col("label"))
    at = F.struct("doc_id", _case({n[0]: n[4] for n in NODES}, "label").alias("step"), "place")
    return known.select("doc_id", _case({n[0]: n[1] for n in NODES}, "label").alias("node"), key.alias("key"), "nome", _case({n[0]: n[2] for n in NODES}, "label").alias("edge"), fonte.alias("fonte"), tipo.alias("tipo"), at.alias("at"))


def acts(relations: DataFrame) -> DataFrame:
    """Relations (doc_id, tipo, head, tail, place) to doc_id, edge, key, nome, person_head, other, at: what persons did."""
    steps = {name: _RELATIONS + k for k, name in enumerate([*PERSON_HEAD, *PERSON_TAIL])}
    first = F.col("tipo").isin(*PERSON_HEAD)
    known = relations.where(F.col("tipo").isin(*steps) & F.col("head").isNotNull() & F.col("tail").isNotNull())
    nome, other = F.when(first, F.trim("head")).otherwise(F.trim("tail")), F.when(first, F.trim("tail")).otherwise(F.trim("head"))
    at = F.struct("doc_id", _case(steps, "tipo").alias("step"), "place")
    return known.select("doc_id", _case(PERSON_HEAD | PERSON_TAIL, "tipo").alias("edge"), normalize(nome).alias("key"), nome.alias("nome"), first.alias("person_head"), other.alias("other"), at.alias("at"))


def entity_nodes(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """NER-10, NER-11: node, key, nome, tipo of the nodes, each created by its first writer.

    A name is replaced by a longer one of a later mention; a relation only names a person that is new. The kind of a law
    is that of its first mention.
    """
    said = mentions(entities).select("node", "key", "nome", "tipo", "at", F.lit(True).alias("mention"))
    done = acts(relations).select(F.lit("PessoaFisica").alias("node"), "key", "nome", F.lit(None).cast("string").alias("tipo"), "at", F.lit(False).alias("mention"))
    every = said.unionByName(done).groupBy("node", "key").agg(
        F.min(F.struct("at", "nome", "tipo")).alias("first"),
        # the longest mention; of equally long ones the first
        F.min(F.when(F.col("mention"), F.struct((-F.length("nome")).alias("size"), "at", "nome"))).alias("best"),
    )
    longer = F.length("best.nome") > F.length("first.nome")
    return every.select("node", "key", F.when(longer, F.col("best.nome")).otherwise(F.col("first.nome")).alias("nome"), F.col("first.tipo").alias("tipo"))


def mention_edges(entities: DataFrame) -> DataFrame:
    """NER-10: doc_id, edge, node, key, fonte: one edge for each document and node, with the origin of its last mention."""
    return mentions(entities).groupBy("doc_id", "edge", "node", "key").agg(F.max_by("fonte", "at").alias("fonte"))


def relation_edges(relations: DataFrame) -> DataFrame:
    """NER-12: doc_id, edge, key, from_person, objeto, agente: edges between a person and a document.

    Where the head is the person, the edge leads from it to the document and keeps the tail (objeto); else it leads from
    the document to the person and keeps the head (agente). Of repeated edges the last one's text stays.
    """
    last = acts(relations).groupBy("doc_id", "edge", "key").agg(F.max_by(F.struct("person_head", "other"), "at").alias("r"))
    head = F.col("r.person_head")
    return last.select("doc_id", "edge", "key", head.alias("from_person"), F.when(head, F.col("r.other")).alias("objeto"), F.when(~head, F.col("r.other")).alias("agente"))


def cleared(nodes: DataFrame, edges: DataFrame, edge_types=EDGES, labels=LABELS) -> tuple[DataFrame, DataFrame]:
    """SNK-07: nodes (node, key) and edges (edge, a_node, a_key, b_node, b_key) without what the entities added.

    Edges of edge_types go. Then, round by round until nothing is left to go: edges of which an end is missing, and nodes
    of labels that no edge holds. A second call changes nothing.
    """
    working = Working(nodes.sparkSession, "cleared")
    edges, step = edges.where(~F.col("edge").isin(*edge_types)), 0
    while True:
        here = nodes.select("node", "key")
        for side in "ab":
            edges = edges.join(here.select(F.col("node").alias(f"{side}_node"), F.col("key").alias(f"{side}_key")), [f"{side}_node", f"{side}_key"], "left_semi")
        edges = working.save(edges, f"edges{step}")
        held = edges.select(F.col("a_node").alias("node"), F.col("a_key").alias("key")).unionByName(edges.select(F.col("b_node").alias("node"), F.col("b_key").alias("key"))).distinct()
        orphans = working.save(nodes.where(F.col("node").isin(*labels)).join(held, ["node", "key"], "left_anti").select("node", "key"), f"orphans{step}")
        if orphans.isEmpty():
            return nodes, edges
        nodes = working.save(nodes.join(orphans, ["node", "key"], "left_anti"), f"nodes{step}")
        step += 1
