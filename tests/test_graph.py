"""Nodes, edges, nested reads, step histories and clearing against plain loops over the rows."""

import random

from pyspark.sql import functions as F

from casebraid.functions import text as texts
from casebraid.operators import history, knowledge, nested, workspace
from casebraid.plans.graph_queries import _KINDS


def fold(changes):
    """The history of one link, change by change."""
    out = {"node": None, "status": None, "start": None, "end": None, "steps": []}
    for at, node, status, user in changes:
        if node is not None and node != out["node"]:
            if out["steps"] and out["steps"][-1][2] is None:
                out["steps"][-1][2] = at
            out["steps"].append([node, at, None, user])
            out["node"] = node
            out["start"] = out["start"] if out["start"] is not None else at
        if status is not None:
            out["status"] = status
            if status == "concluido":
                out["end"] = at
                if out["steps"] and out["steps"][-1][2] is None:
                    out["steps"][-1][2] = at
    return out


def test_history_equals_the_fold(spark):
    own = random.Random(4)
    rows = [(link, at, own.choice([None, "a", "b", "c"]), own.choice([None, None, "aberto", "concluido"]), f"u{own.randrange(3)}") for link in range(60) for at in range(own.randrange(1, 9))]
    table = spark.createDataFrame([*rows, (None, 1, "a", None, "u"), (3, None, "a", None, "u")], "link int, at int, node string, status string, usuario string").repartition(5)
    got = {r.link: r for r in history.step_history(table).collect()}
    assert set(got) == {r[0] for r in rows}
    for link, r in got.items():
        want = fold([c[1:] for c in rows if c[0] == link])
        assert (r.node_atual, r.status, r.iniciado_em, r.concluido_em) == (want["node"], want["status"], want["start"], want["end"])
        assert [list(s) for s in r.historico] == want["steps"]
    assert history.step_history(table.limit(0)).count() == 0


def write(entities, relations):
    """The writes one after another, document by document: nodes, edges of mentions, edges of relations."""
    plain = lambda t: " ".join(t.lower().split())
    labels = {n[0]: n for n in knowledge.NODES}
    nodes, mention, acted = {}, {}, {}
    for doc in sorted({e[0] for e in entities} | {r[0] for r in relations}):
        for _, label, text, canonical, origin, _ in sorted((e for e in entities if e[0] == doc and e[1] in labels), key=lambda e: (labels[e[1]][4], e[5])):
            nome = canonical or text
            if not nome:
                continue
            _, node, edge, norm, _ = labels[label]
            key = (node, plain(nome) if norm else nome)
            if key not in nodes:
                nodes[key] = [nome, label if node == "Legislacao" else None]
            elif norm and len(nome) > len(nodes[key][0]):
                nodes[key][0] = nome
            mention[doc, edge, *key] = origin if origin in knowledge.ORIGINS else "gliner"
        for _, tipo, head, tail, _ in sorted((r for r in relations if r[0] == doc and r[1] in _KINDS), key=lambda r: (_KINDS.index(r[1]), r[4])):
            first = tipo in knowledge.PERSON_HEAD
            nome, other = (head, tail) if first else (tail, head)
            nodes.setdefault(("PessoaFisica", plain(nome.strip())), [nome.strip(), None])
            acted[doc, (knowledge.PERSON_HEAD | knowledge.PERSON_TAIL)[tipo], plain(nome.strip())] = (first, other.strip())
    return nodes, mention, acted


def test_graph_equals_the_writes(spark):
    own = random.Random(9)
    names = ["Ana", "ANA", "ana ", "Rui", "Rui  Lima", "rui lima", "Lei 3", ""]
    labels = [n[0] for n in knowledge.NODES] + ["url"]
    entities = [(own.randrange(12), own.choice(labels), own.choice(names), own.choice([None, "", "Ana Maria", "ana maria"]), own.choice([None, "llm", "hybrid", "x"]), k) for k in range(150)]
    relations = [(own.randrange(12), own.choice([*_KINDS, "other"]), own.choice([" Rui Lima", "Zoe", "ANA"]), own.choice(["Ana", "Zoe ", "obra"]), k) for k in range(80)]
    e = spark.createDataFrame(entities, "doc_id int, label string, text string, canonical string, provenance string, place int").repartition(4)
    r = spark.createDataFrame(relations, "doc_id int, tipo string, head string, tail string, place int").repartition(4)
    nodes, mention, acted = write(entities, relations)
    assert {(x.node, x.key): [x.nome, x.tipo] for x in knowledge.entity_nodes(e, r).collect()} == nodes
    assert {(x.doc_id, x.edge, x.node, x.key): x.fonte for x in knowledge.mention_edges(e).collect()} == mention
    assert {(x.doc_id, x.edge, x.key): (x.from_person, x.objeto if x.from_person else x.agente) for x in knowledge.relation_edges(r).collect()} == acted


def test_clearing_ends_when_no_orphan_is_left(spark):
    nodes = [("Documento", "1"), ("PessoaFisica", "a"), ("PessoaFisica", "b"), ("PessoaFisica", "c"), ("CargoFuncao", "d"), ("CargoFuncao", "e"), ("Orgao", "o")]
    # a hangs on a document that is gone, e on a node that is gone with it; c and d hold each other
    edges = [("MENCIONA_PESSOA", "Documento", "1", "PessoaFisica", "b"), ("CITA", "Documento", "9", "PessoaFisica", "a"), ("TEM", "PessoaFisica", "x", "CargoFuncao", "e"), ("TEM", "PessoaFisica", "c", "CargoFuncao", "d"), ("ASSINOU", "PessoaFisica", "c", "Documento", "1")]
    n, e = spark.createDataFrame(nodes, "node string, key string"), spark.createDataFrame(edges, "edge string, a_node string, a_key string, b_node string, b_key string")
    for _ in range(2):  # the second time nothing changes
        n, e = knowledge.cleared(n, e)
        assert sorted(map(tuple, n.collect())) == [("CargoFuncao", "d"), ("Documento", "1"), ("Orgao", "o"), ("PessoaFisica", "c")]
        assert [(r.edge, r.a_key, r.b_key) for r in e.select("edge", "a_key", "b_key").collect()] == [("TEM", "c", "d")]


def test_cases_without_documents_have_no_row(spark):
    documents = spark.createDataFrame([(1, "d2", "x"), (1, "d1", None), (1, "d1", None), (2, None, "x"), (None, "d9", "x"), (3, "d3", "y")], "processo int, numero string, tipo string")
    visits = spark.createDataFrame([(1, "O", "O/A", 5), (1, "O", "O/B", None), (2, "O", "O/A", 5), (3, "P", "P/A", 7)], "processo int, orgao string, sigla string, id_unidade int")
    creators = spark.createDataFrame([(1, "d1", "O/A", 5), (1, "d2", "O/B", None)], "processo int, numero string, sigla string, id_unidade int")
    plain = lambda r: (r.processo, [tuple(d) for d in r.documentos], [tuple(u) for u in r.unidades], [tuple(c) for c in r.criadores])
    every = sorted(map(plain, nested.case_reads(documents, visits, creators).collect()))
    assert every == [(1, [("d1", None), ("d2", "x")], [("O/A", 5)], [("d1", "O/A", 5)]), (3, [("d3", "y")], [("P/A", 7)], [])]
    assert [r.processo for r in nested.case_reads(documents, visits, creators, organ="O").collect()] == [1]
    assert [r.processo for r in nested.case_reads(documents, visits, creators, cases=[3, 2]).collect()] == [3]


def test_boards_and_names(spark):
    schema = "tag_id int, equipe_id int, nome string, criado_em int, deletado_em int"
    tags = spark.createDataFrame([(1, 7, "a", 1, None), (2, 7, "b", 2, None), (3, 7, "c", 3, 1), (4, None, "d", 4, None)], schema)
    saved = spark.createDataFrame([(1, 10, 1, None), (1, 11, 2, None), (1, 12, 3, 9), (3, 10, 4, None)], "tag_id int, numero int, criado_em int, deletado_em int")
    labels = spark.createDataFrame([(5, 7, "y", None), (6, 7, "x", None), (8, 9, "other team", None)], "label_id int, equipe_id int, nome string, deletado_em int")
    labelled = spark.createDataFrame([(10, 5, None), (10, 6, None), (10, 8, None), (11, 5, 3)], "numero int, label_id int, deletado_em int")
    got = {r.tag_id: [(p.numero, p.etiquetas) for p in r.processos] for r in workspace.boards(tags, saved, labels, labelled).collect()}
    assert got == {1: [(11, []), (10, ["x", "y"])], 2: []}
    rows = spark.createDataFrame([("@ana e @rui.lima, @ana; x@y.z", "TipoAcao-Grupo")], "t string, c string")
    assert list(rows.select(texts.mentions(rows.t), texts.snake(rows.c)).first()) == [["ana", "rui.lima", "y.z"], "tipo_acao_grupo"]


def test_html_becomes_text(spark):
    pages = [
        ("<html><head><style media=x>p {a: b}</style><SCRIPT type='x'>if (a < b) {}</SCRIPT></head><body><!-- <p>no</p> --><p>Caf&eacute; &amp; <b>p&atilde;o</b>&nbsp;1 &lt; 2</p>\n\n<div>fim 0A1B2C3D</div>"
         "<p>DOCUMENTO ASSINADO eletronicamente por <b>x</b></p><p>more</p></body></html>", "Café & pão 1 < 2 fim"),
        ("&#233;&#xE9;&#x1F600; &unknown; &amp;lt; a&b; R&D", "éé\U0001F600 &unknown; &lt; a&b; R&D"),
        ("texto <b>longo</b> Referência: Processo nº 1", "texto longo"),
        ("nada < aqui", "nada < aqui"), (None, None), ("", ""),
    ]
    got = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(pages)], "k int, h string").orderBy("k").select(texts.html_text(F.col("h")).alias("t")).collect()
    assert [r.t for r in got] == [t for _, t in pages]
