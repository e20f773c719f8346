"""Small contact lake of our own, made to hold blanks, NULLs, repeated e-mails
and members of block files; results are held against DuckDB on the same rows."""

import itertools

import duckdb

CITIES = ("Oslo", "Quito", None, "Lagos")
CARDS = ("gold", None, "plain")
BANKS = ("north", "south", None, "east", "")

COLUMNS = """id bigint, account_id int, primary_key string, email string, mobile string, email_status tinyint,
sms_status tinyint, is_deleted tinyint, is_contact tinyint, is_preview tinyint, last_emailed int, last_sms int,
f2 string, f6 string, f7 string, f18 string, f30 string, f31 tinyint"""


def rows():
    out = []
    for n, (city, card, bank) in enumerate(itertools.product(CITIES, CARDS, BANKS), 1):
        email = None if n % 17 == 0 else " " if n % 19 == 0 else f"p{n % 41}@mail.test"
        out.append((n, 6 if n % 7 else 5, f"key{n}", email, f"+47{n:06d}" if n % 4 else None, 1 + n % 6, n % 7,
                    1 if n % 23 == 0 else 0, 1, 0, 0 if n % 3 else 1_699_990_000 + 400 * n, None if n % 5 else 7,
                    f"card{n:03d}" if n % 9 else None, bank, f"20{n % 24:02d}-{1 + n % 12:02d}-{1 + n % 28:02d}", city,
                    card, n % 60))
    return out


def lake_contacts(spark):
    return spark.createDataFrame(rows(), COLUMNS)


BLOCKS = [(21, f"card{n:03d}") for n in range(1, 60, 4)] + [(22, f"card{n:03d}") for n in range(2, 60, 5)] + [
    (21, "card001"), (22, None)]


def block_files(spark):
    return spark.createDataFrame(BLOCKS, "block_file_id bigint, unique_identifier string")


def duck():
    """DuckDB connection with the same rows as views ``c`` and ``b``."""
    con = duckdb.connect()
    con.execute("create table c (" + COLUMNS.replace(" string", " varchar") + ")")
    con.executemany("insert into c values (" + ", ".join("?" * 18) + ")", rows())
    con.execute("create table b (block_file_id bigint, unique_identifier varchar)")
    con.executemany("insert into b values (?, ?)", BLOCKS)
    return con


def rule(kind, operator, *options):
    return {"type": kind, "operator": operator, "options": list(options)}


#: Segment definitions by id, and the same as SQL.
SEGMENTS = {
    "10": [[rule("attributes", "text_attr_in", "f18", "Oslo", "Lagos"), rule("attributes", "number_attr_gte", "f31", 8)]],
    "11": [[rule("attributes", "text_attr_equals", "f6", "south")], [rule("attributes", "text_attr_is_null", "f30")]],
    "12": [[rule("segments", "in_all_segments", 10, 11)]],
}
SEGMENT_SQL = {"10": "(f18 in ('Oslo', 'Lagos') and f31 >= 8)", "11": "(f6 = 'south' or f30 is null)"}
SEGMENT_SQL["12"] = f"({SEGMENT_SQL['10']} and {SEGMENT_SQL['11']})"


def block_sql(i):
    return f"exists (select 1 from b where block_file_id = {i} and unique_identifier = f2)"
