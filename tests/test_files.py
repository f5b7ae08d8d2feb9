"""Readers of case files and what they count."""

from casebraid.sources import files


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_texts_and_entities(spark, tmp_path):
    put(tmp_path / "t/001.txt", "  um texto\nem linhas \n")
    put(tmp_path / "t/sub/002.txt", " \n\t")
    put(tmp_path / "t/003.md", "outro")
    assert [tuple(r) for r in files.parsed_texts(spark, str(tmp_path / "t")).collect()] == [("001", "um texto\nem linhas")]
    put(tmp_path / "e/7.json", '{"entities": {"pessoa": ["Ana", "Rui"]},\n "x": 1}')
    put(tmp_path / "e/8.json", "broken")
    assert [(r.numero, r.entities) for r in files.entity_files(spark, str(tmp_path / "e")).collect()] == [("7", {"pessoa": ["Ana", "Rui"]})]


def test_units(spark, tmp_path):
    put(tmp_path / "u.csv", "IdUnidade,Sigla,Descricao\n1, A/B ,Setor\n2,,nada\n")
    assert [tuple(r) for r in files.units_csv(spark, str(tmp_path / "u.csv")).collect()] == [("A/B", "1", "Setor")]
    assert files.units_csv(spark, None).count() == 0


def test_walk_and_statistics(spark, tmp_path):
    for name in ("1_2024/10/a.PDF", "1_2024/10/b.txt", "1_2024/11/c.pdf", "2_2024/12/d.xyz"):
        put(tmp_path / name, "1234")
    found = files.walk(spark, str(tmp_path))
    assert found.count() == 4 and files.walk(spark, str(tmp_path), [".pdf"], ["1/2024"]).count() == 2
    got = {r.extensao: (r.classe, r.n, r["bytes"], r.share, r.documentos) for r in files.extension_stats(found).collect()}
    assert got == {".pdf": ("vision", 2, 8, 50.0, 2), ".txt": ("local", 1, 4, 25.0, 1), ".xyz": ("other", 1, 4, 25.0, 1)}


LOG = """2024-01-01 10:00:00 Trying doc 1 with unidade A B (id=7)
2024-01-01 10:00:01 HTTP 422 for doc 1 unidade 7: Acesso negado
2024-01-01 10:00:02 Trying doc 1 with unidade C (id=8)
2024-01-01 10:00:03 HTTP Request: GET x "HTTP/1.1 200 OK"
Downloaded doc 1 via unidade C
Doc 9 is CANCELLED
[1/2] Processo 1/2024: 3 downloaded, 1 failed, 0 cancelled, 2 skipped
[2/2] Processo 2/2024: 4 downloaded, 0 failed, 1 cancelled, 0 skipped
2024-01-01 10:00:04 Trying doc 2 with unidade C (id=8)
HTTP 500 for doc 2 unidade 8: o documento foi cancelado
All 2 unidades failed for doc 3: A, C
nothing to see
"""


def test_log(spark, tmp_path):
    put(tmp_path / "d.log", LOG)
    lines = files.log_lines(spark, str(tmp_path / "d.log"))
    assert lines.count() == 11 and lines.where("ts is null").count() == 6
    got = {(r.grupo, r.chave): r.n for r in files.log_report(lines).collect()}
    assert got[("linhas", "trying")] == 3 and got[("erros", "acesso_negado")] == 1 and got[("erros", "cancelado")] == 1
    assert [got[("totais", k)] for k in ("downloaded", "failed", "cancelled", "skipped")] == [7, 1, 1, 2] and got[("linhas", "cancelled")] == 1
    assert got[("baixados", "C")] == 1 and got[("recusas", "7")] == 1 and got[("tentativas", "2")] == got[("tentativas", "1")] == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Ofício"), (2, " ofício "), (3, ""), (4, None), (5, "Nota")], "id long, nome string")
    assert sorted(r.id for r in files.first_by_name(rows, "nome", "id").collect()) == [1, 5]
    for _ in range(2):
        files.append_csv(rows.where("id = 5"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), sep=";", header=True).count() == 2
