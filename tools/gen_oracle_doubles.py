"""Regenerate routewise/plans/oracle_doubles.py: the DOUBLE output columns of
each oracle SQL (so the oracle can round them exactly like the Spark side)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb  # noqa: E402

from routewise.plans import catalog  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
con = duckdb.connect()
for t in catalog.TABLES_FOR_ORACLE:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
out, wide = {}, {}
for k, sql in sorted(catalog.ORACLE.items()):
    cols = con.execute(f"DESCRIBE {sql}").fetchall()
    out[k] = [c[0] for c in cols if c[1] in ("DOUBLE", "FLOAT")]
    wide[k] = [c[0] for c in cols if c[1] in ("HUGEINT", "UHUGEINT")]
    if any(c[1].startswith("DECIMAL") for c in cols):
        print("WARNING decimal output", k, [c for c in cols if c[1].startswith("DECIMAL")])
    odd = [(c[0], c[1]) for c in cols if c[1] not in ("DOUBLE", "FLOAT", "BIGINT", "INTEGER", "VARCHAR",
                                                       "HUGEINT", "BOOLEAN") and not c[1].startswith("DECIMAL")]
    if odd:
        print("note", k, odd)
path = os.path.join(os.path.dirname(catalog.__file__), "oracle_doubles.py")
with open(path, "w") as f:
    f.write('"""Generated by tools/gen_oracle_doubles.py: DOUBLE output columns per oracle query."""\n\n')
    f.write("DOUBLE_COLUMNS = {\n")
    for k, v in out.items():
        f.write(f"    {k!r}: {v!r},\n")
    f.write("}\n\n")
    f.write("# integer-valued columns DuckDB widens (HUGEINT) or makes DECIMAL: cast to BIGINT / DOUBLE\n")
    f.write("WIDE_COLUMNS = {\n")
    for k, v in wide.items():
        if v:
            f.write(f"    {k!r}: {v!r},\n")
    f.write("}\n")
print(len(out), "queries")
