import pytest

from copperleaf.functions.codecs import expand
from copperleaf.plans import ddl
from copperleaf.plans.catalog import CUSTOMER, EVENT, LINE, ORDER, ORDER_LINES
from copperleaf.plans.copybook import parse, preprocess, program_facts
from copperleaf.plans.layout import analyse, lay_out
from copperleaf.plans.schema import Options, compile_copybook, from_json, sql_type, to_json


def items(text):
    return parse(text, free=True)


def test_pictures():
    assert [expand(p) for p in ("X", "X(5)", "9(3)", "S9(5)V9(2)", "999")] == ["X", "XXXXX", "999", "S99999V99", "999"]
    p = analyse("S9(7)V9(2)")
    assert (p.digits, p.decimals, p.signed, p.category) == (7, 2, True, "NUMERIC")
    assert [analyse(x).category for x in ("X(3)", "A(3)", "XX99", "ZZ9.99", "")] == ["ALPHANUMERIC", "ALPHABETIC", "ALPHANUMERIC_EDITED", "NUMERIC_EDITED", "ALPHANUMERIC"]
    for bad in ("9(5)P", "9(39)"):
        with pytest.raises(ValueError):
            analyse(bad)


@pytest.mark.parametrize(("text", "n"), [("X(10)", 10), ("9(5)", 5), ("S9(5)", 5), ("9(5) COMP-3", 3), ("9(4) COMP-3", 3), ("9(9) COMP-3", 5), ("9(4) COMP", 2), ("9(9) COMP", 4), ("9(18) COMP", 8), ("S9(5) SIGN TRAILING SEPARATE", 6), ("9(5) COMP-6", 3)])
def test_lengths(text, n):
    [x] = items(f"01 F PIC {text}.")
    assert lay_out([x]) == n


def test_floats_need_no_picture():
    r = items("01 R.\n 05 A COMP-1.\n 05 B USAGE IS COMPUTATIONAL-2.\n 05 I INDEX.")
    assert lay_out(r) == 16
    assert [sql_type(x).spark for x in r[0].children] == ["float", "double", "bigint"]


def test_tree():
    [r] = items("01 PARENT. 05 A PIC X(30). 05 G. 10 B PIC S9(7)V9(2) COMP-3. 10 C PIC 9. 05 FILLER PIC X. 66 N RENAMES A. 05 S PIC X. 88 ACTIVE VALUE 'A'. 88 INACTIVE VALUES 'I' 'NOT FOUND' THRU 'Z'.")
    assert [c.name for c in r.children] == ["A", "G", "FILLER", "S"]
    assert r.children[0].picture == "X(30)" and [c.name for c in r.children[1].children] == ["B", "C"]
    assert [c.values for c in r.children[3].conditions] == [["A"], ["I", "NOT FOUND"]]
    assert r.children[2].filler


def test_occurs_and_redefines():
    [r] = items("01 R. 05 N PIC 99. 05 T OCCURS 1 TO 10 TIMES DEPENDING ON N INDEXED BY IX. 10 X PIC X(5). 05 U PIC X(3) OCCURS 3. 05 V REDEFINES U PIC 9(9).")
    t, u, v = r.children[1:]
    assert lay_out([r]) == 2 + 50 + 9
    assert (t.occurs.least, t.occurs.most, t.occurs.depending_on, t.occurs.indexed_by) == (1, 10, "N", ["IX"])
    assert (u.offset, u.size, v.offset, v.redefines) == (52, 9, 52, "U")


def test_sync_pads_before():
    [r] = items("01 R. 05 A PIC X. 05 B PIC 9(9) COMP SYNC. 05 C PIC X.")
    assert lay_out([r]) == 9 and [(c.offset, c.length) for c in r.children] == [(0, 1), (4, 4), (8, 1)]


@pytest.mark.parametrize(("text", "n"), [(CUSTOMER, 44), (ORDER, 48), (LINE, 48), (ORDER_LINES, 250), (EVENT, 28)])
def test_layouts(text, n):
    assert compile_copybook(text, free=True).tables[0].record_length == n


def test_fixed_format_and_copy(tmp_path):
    (tmp_path / "INNER.cpy").write_text("000100     05 :P:-ID PIC 9(5).\n")
    text = "000100* comment\n000200 01 R.\n000300     COPY INNER REPLACING ==:P:== BY ==CUST==.\n000400     05 NAME PIC X(\n000500-        8).\n000600     COPY NOWHERE.\n000700D    05 T PIC X.\n"
    [r] = parse(text, [str(tmp_path)])
    assert [(c.name, c.picture) for c in r.children] == [("CUST-ID", "9(5)"), ("NAME", "X(8)"), ("T", "X")]
    assert "COPY NOWHERE NOT FOUND" in preprocess(text, [str(tmp_path)])
    (tmp_path / "LOOP.cpy").write_text("000100     COPY LOOP.\n")
    assert "CIRCULAR" in preprocess("000100     COPY LOOP.\n", [str(tmp_path)])
    assert "B-ID" in preprocess("REPLACE ==A== BY ==B==.\n05 A-ID PIC 9.\nREPLACE OFF.\n", free=True)


def test_program_facts():
    facts = program_facts(
        """       IDENTIFICATION DIVISION.
       PROGRAM-ID. DEMO.
       ENVIRONMENT DIVISION.
           SELECT CUSTFILE ASSIGN TO CUSTDD
           ORGANIZATION IS INDEXED RECORD KEY IS CUST-ID
           ALTERNATE RECORD KEY IS CUST-NAME FILE STATUS IS WS-ST.
       DATA DIVISION.
       FD CUSTFILE RECORDING MODE IS V.
       PROCEDURE DIVISION.
       MAIN-PARA.
           EXEC SQL SELECT A INTO :HV-A FROM T END-EXEC.
           EVALUATE REC-TYPE WHEN 'O' CALL 'ORDERS'
           WHEN 'L' CONTINUE END-EVALUATE.
""".replace("\n       ", "\n000000 ").replace("       IDENT", "000000 IDENT", 1).replace("\n           ", "\n000000     ")
    )
    assert facts["program"] == ["DEMO"] and facts["host_variables"] == ["HV-A"] and facts["calls"] == ["ORDERS"]
    assert facts["files"][0]["key"] == "CUST-ID" and facts["files"][0]["alternate"] == "CUST-NAME"
    assert facts["tested"] == [("REC-TYPE", ["'O'", "'L'"])] and facts["formats"] == [("CUSTFILE", "V")] and facts["paragraphs"] == ["MAIN-PARA"]


def test_schema(spark):
    schema = compile_copybook("01 ORDER-REC. 05 ORDER-ID PIC 9(8). 05 FILLER PIC X. 05 S PIC X. 88 A VALUE 'A' 'I'. 05 LINE-ITEM OCCURS 10. 10 QTY PIC 9(3). 10 QTY PIC 9(3). 77 W PIC 9.", free=True)
    main, child, scalars = schema.tables
    assert [c.name for c in main.columns] == ["order_id", "s"] and main.primary_key == ["order_id"]
    assert child.name == "order_rec_line_item" and [c.name for c in child.columns] == ["order_id", "occurrence_index", "qty", "qty_2"]
    assert schema.relationships[0].name == "fk_order_rec_line_item_order_rec" and scalars.name == "_scalars"
    assert main.column("s").check == ["A", "I"]
    assert from_json(to_json(schema)) == schema
    assert main.struct()["order_id"].metadata["length"] == 8
    wide = compile_copybook("01 R. 05 ITEM-CODE PIC X(5) OCCURS 3.", Options(occurs="wide"), free=True).tables[0]
    assert [(c.name, c.offset) for c in wide.columns] == [("item_code_1", 0), ("item_code_2", 5), ("item_code_3", 10)]


def test_ddl():
    schema = compile_copybook("01 CUSTOMER. 05 CUSTOMER-ID PIC 9(9) COMP. 05 NAME PIC X(30). 88 K VALUE 'O''X'. 05 BALANCE PIC S9(7)V99 COMP-3. 05 T OCCURS 2. 10 C PIC X.", free=True)
    pg = ddl.script(schema, comments=True)
    assert '"public"."customer"' in pg and '"customer_id" INTEGER NOT NULL' in pg and '"name" VARCHAR(30)' in pg and '"balance" NUMERIC(9,2)' in pg
    assert "PRIMARY KEY (\"customer_id\")" in pg and "IN ('O''X')" in pg and "FOREIGN KEY" in pg
    assert all(not line.split("--")[0].strip() for line in pg.splitlines() if "--" in line)
    ms = ddl.script(schema, "sqlserver")
    assert "[dbo].[customer]" in ms and "NVARCHAR(30)" in ms and "IF NOT EXISTS" not in ms
    assert "USING parquet" in ddl.script(schema, "spark")
    assert ddl.migration_name("1.2", "first load") == "V1.2__first_load.sql"
