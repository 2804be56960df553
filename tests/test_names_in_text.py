"""Names found in sheet headers and texts."""

from worktally.operators import normalise as NO


def test_names_above_the_headers(spark):
    head = ["Date", "Time In", "Time Out", "Total Hours"]
    files = {1: [["Sheet"], ["Employee: Ana Lopez", "12"], head], 2: [["Worker: Main Street Office"], ["Page", "Boris Smith"], head],
             3: [["to: a@b.c", "Chloe Ito"], ["Name: Dan Ruiz"], head], 4: [["12/1", "Ann-Mary Ito"], ["Client Manager"], ["lower case"], head],
             5: [head], 6: [["no header"], ["Eve Novak"]], 7: [["", "GRETA DE COSTA", ""], head, ["Employee: Not This"]]}
    cells = [(f, r, c, v) for f, rows in files.items() for r, row in enumerate(rows) for c, v in enumerate(row)]
    rows = NO.grid_rows(spark.createDataFrame(cells, "file_id long, row_no int, col_no int, value string"))
    got = {x.file_id: x.name for x in NO.name_from_header(rows).collect()}
    assert got == {1: "Ana Lopez", 2: "Boris Smith", 3: "Dan Ruiz", 4: None, 5: None, 7: "GRETA DE COSTA"}


def test_names_in_texts(spark):
    texts = {1: ["Zed Quill | Employee signature", "Submitted by: Ana Lopez"], 2: ["hours", "Prepared by   Boris Smith"], 3: ["Consultant: X1", "for Employee: Chloe Ito"], 7: ["nothing"]}
    lines = [(d, i, x) for d, t in texts.items() for i, x in enumerate(t)]
    got = {x.doc_id: x.name for x in NO.name_from_lines(spark.createDataFrame(lines, "doc_id long, line_no int, line string")).collect()}
    assert got == {1: "signature", 2: "Boris Smith", 3: "Chloe Ito", 7: None}
