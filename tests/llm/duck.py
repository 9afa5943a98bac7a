import duckdb


def rows(sql, **frames):
    """Sorted rows of a query over Spark frames, with the columns in the order of their names."""
    con = duckdb.connect()
    for name, frame in frames.items():
        table = frame.toArrow()
        con.register(name, table)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return tidy([dict(zip(names, r)) for r in got.fetchall()])


def tidy(records):
    def cell(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v

    return sorted((tuple((k, cell(v)) for k, v in sorted(r.items())) for r in records), key=repr)


def spark_rows(frame):
    return tidy([r.asDict() for r in frame.collect()])
