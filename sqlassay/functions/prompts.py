"""Prompt text from columns: schema descriptions, examples, and assembly within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Instructions of the templates, by name.
TEMPLATES = {
    "zero_shot": "Write one SQL query that answers the question.",
    "few_shot": "Write one SQL query that answers the question. Examples follow.",
    "step_by_step": "Think about tables, columns, conditions and grouping in turn, then write one SQL query.",
    "self_correct": "The query below failed. Write a corrected one.",
    "explain": "Explain in plain words what the query does.",
    "optimise": "Rewrite the query so that it reads less and returns the same.",
    "debug": "Find the fault in the query and correct it.",
}


def schema_text(catalog: DataFrame, key: str = "db_id") -> DataFrame:
    """(key, schema): a line ``table(a, b)`` for each table, columns in order."""
    cols = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "column"))), lambda x: x["column"]), ", ")
    lines = catalog.groupBy(key, "table").agg(F.concat(F.col("table"), F.lit("("), cols, F.lit(")")).alias("line"))
    return lines.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("schema"))


def foreign_key_text(keys: DataFrame, key: str = "db_id") -> DataFrame:
    line = F.concat(F.concat_ws(".", "from_table", "from_column"), F.lit(" = "), F.concat_ws(".", "to_table", "to_column"))
    return keys.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("foreign_keys"))


def table_text(table: Column, columns: Column, rows: Column, most: int = 3) -> Column:
    """A table's name, columns and first rows."""
    shown = F.transform(F.slice(rows, 1, most), lambda r: F.array_join(r, " | "))
    return F.concat_ws("\n", F.concat(F.lit("Table: "), table), F.concat(F.lit("Columns: "), F.array_join(columns, ", ")), F.nullif(F.array_join(shown, "\n"), F.lit("")))


def assemble(required: Column, blocks: Column, budget: int, chars_per_token: int = 4) -> Column:
    """``required`` and then each optional block, in order, that still fits into ``budget`` tokens."""
    size = lambda c: F.ceil(F.length(c) / chars_per_token)
    start = F.struct((F.lit(budget) - size(required)).cast("long").alias("left"), required.alias("text"))

    def add(acc: Column, b: Column) -> Column:
        fits = (F.length(b) > 0) & (size(b) <= acc["left"])
        return F.struct(F.when(fits, acc["left"] - size(b)).otherwise(acc["left"]).cast("long").alias("left"), F.when(fits, F.concat_ws("\n\n", acc["text"], b)).otherwise(acc["text"]).alias("text"))

    return F.aggregate(blocks, start, add, lambda a: a["text"])


def prompt(template: str, question: Column, schema: Column, *extra: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(TEMPLATES[template]), F.concat(F.lit("Schema:\n"), schema), *extra, F.concat(F.lit("Question: "), question), F.lit("SQL:"))


# ---- composed prompts --------------------------------------------------------------------

# What questions say, and the shape of statement it stands for.
PATTERNS = {
    "How many": "SELECT COUNT(*) FROM table", "List all": "SELECT * FROM table", "Top N/Highest N": "SELECT columns FROM table ORDER BY column DESC LIMIT N",
    "Bottom N/Lowest N": "SELECT columns FROM table ORDER BY column ASC LIMIT N", "Average/Mean": "SELECT AVG(column) FROM table", "Total/Sum": "SELECT SUM(column) FROM table",
    "Count by group": "SELECT group_column, COUNT(*) FROM table GROUP BY group_column", "Contains/Includes": "WHERE column LIKE '%value%'", "Between": "WHERE column BETWEEN value1 AND value2",
}
#: What a statement must keep to.
RULES = (
    "Schema Compliance: name only tables and columns that the schema has",
    "Syntax Correctness: write one statement that runs as it stands",
    "JOIN Requirements: give every joined table its condition",
    "Aggregate Rules: group by each plain column beside an aggregate",
    "String Quoting: put text in single quotes, numbers in none",
    "NULL Handling: test for null with IS NULL and IS NOT NULL",
    "Column Qualification: with several tables, name the table of each column",
)
CRITICAL = ("a statement over a single table uses no alias", "JOIN is written plainly, without INNER, LEFT or RIGHT", "CASE is not used", "no semicolon follows")
#: Examples of schema, question, statement and why.
EXAMPLES = (
    ("singer(id, name, country)", "How many singers are there?", "SELECT COUNT(*) FROM singer", "every row is one singer"),
    ("singer(id, name, country)", "Which countries have singers?", "SELECT DISTINCT country FROM singer", "a country counts once"),
    ("shop(id, city), sale(shop_id, price)", "What did each city sell for?", "SELECT T1.city, SUM(T2.price) FROM shop AS T1 JOIN sale AS T2 ON T1.id = T2.shop_id GROUP BY T1.city", "sales lie in another table"),
    ("car(id, maker, year)", "Who made the newest car?", "SELECT maker FROM car ORDER BY year DESC LIMIT 1", "the largest year comes first"),
    ("pupil(id, age)", "How old are pupils on average?", "SELECT AVG(age) FROM pupil", "one number for all rows"),
)
#: Steps of the composed templates that reason.
STEPS = ("Analyze the question", "Schema Mapping: find tables and columns", "Query Structure Planning: joins, filters, groups", "SQL Construction", "Validation Check against schema and rules")
#: What the special prompts ask for: task, and what is to be answered.
SPECIAL = {
    "debug": ("You are an SQL debugging expert. Find the fault and mend it.", ("Error Analysis", "Corrected SQL", "Explanation")),
    "optimise": ("You are an SQL optimization expert. Make the query read less with the same result.", ("Performance Analysis", "Optimized SQL", "Optimization Explanation")),
    "explain": ("You are an SQL education expert. Say in plain words what the query does.", ("Query Breakdown", "Logic Flow", "Result Description")),
}
KINDS = ("basic", "few_shot", "chain_of_thought", "rule_based", "enhanced", "step_by_step")


def rules_text() -> str:
    return "\n".join(f"{k}. {r}" for k, r in enumerate(RULES, 1))


def critical_text() -> str:
    return "\n".join(f"- {r}" for r in CRITICAL)


def patterns_text() -> str:
    return "\n".join(f"- {k}: {v}" for k, v in PATTERNS.items())


def examples_text(most: int = 5, explained: bool = True) -> str:
    blocks = []
    for k, (schema, question, sql, why) in enumerate(EXAMPLES[:most], 1):
        lines = [f"Example {k}:", f"Schema: {schema}", f"Question: {question}", f"SQL: {sql}"] + [f"Explanation: {why}"] * explained
        blocks.append("\n".join(lines))
    return "\n\n".join(blocks)


def composed(question: Column, schema: Column, examples: int = 5, rules: bool = True, patterns: bool = True, reasoning: bool = False) -> Column:
    """A prompt of the chosen parts; the critical rules are always there."""
    parts = ["You are an expert SQL developer. Turn the question into one SQL query."]
    parts += [f"## VALIDATION RULES:\n{rules_text()}"] * rules + [f"## COMMON PATTERNS:\n{patterns_text()}"] * patterns
    parts += [examples_text(examples)] * (examples > 0) + ["## REASONING PROCESS:\n" + "\n".join(f"{k}. {s}" for k, s in enumerate(STEPS, 1))] * reasoning
    parts.append(f"## CRITICAL RULES (MUST FOLLOW):\n{critical_text()}")
    return F.concat(F.lit("\n\n".join(parts) + "\n\nDatabase Schema:\n"), schema, F.lit("\n\nQuestion:\n"), question, F.lit("\n\nSQL Query:"))


def of_kind(kind: str, question: Column, schema: Column, examples: int = 5) -> Column:
    """The six ready kinds; an unknown kind is basic."""
    if kind == "few_shot":
        return composed(question, schema, examples, rules=False, patterns=False)
    if kind == "chain_of_thought":
        return composed(question, schema, 0, rules=False, patterns=False, reasoning=True)
    if kind == "rule_based":
        return composed(question, schema, 0)
    if kind == "enhanced":
        return composed(question, schema, examples)
    if kind == "step_by_step":
        steps = "\n".join(f"Step {k}: {s}" for k, s in enumerate(STEPS, 1))
        return F.concat(F.lit(steps + "\n\n"), composed(question, schema, 0, rules=False, patterns=False))
    return composed(question, schema, 0, rules=False, patterns=False)


def special(kind: str, question: Column, schema: Column, sql: Column, error: Column | None = None) -> Column:
    """A prompt to debug, optimise or explain a statement."""
    task, wanted = SPECIAL[kind]
    asked = "Please provide:\n" + "\n".join(f"{k}. {w}" for k, w in enumerate(wanted, 1))
    lines = [F.lit(task), F.concat(F.lit("Question: "), question), F.concat(F.lit("Schema: "), schema), F.concat(F.lit("SQL: "), sql)]
    if error is not None:
        lines.append(F.concat(F.lit("Error: "), error))
    return F.concat_ws("\n\n", *lines, F.lit(asked))


def decomposition_class(reply: Column) -> Column:
    """EASY, NON-NESTED or NESTED from a classification reply."""
    label = F.upper(F.regexp_extract(reply, r"""(?i)Label:\s*["']?\s*(NON-NESTED|NESTED|EASY)""", 1))
    return F.when(label != "", label).when(F.upper(reply).contains("NON-NESTED"), "NON-NESTED").when(F.upper(reply).contains("NESTED"), "NESTED").otherwise("EASY")


def schema_links(reply: Column) -> Column:
    """Names in the brackets that end a schema-linking reply."""
    inside = F.regexp_extract(reply, r"(?is)Schema_links:\s*\[([^\]]*)\]", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: x != "")


def is_server_error(message: Column) -> Column:
    return F.lower(message).rlike("500|503|429|unavailable|deadline|resource.?exhausted|timed? ?out")
