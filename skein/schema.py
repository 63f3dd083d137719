"""Record types of the code graph.

Inside the engine columns are in lower case and carry ``project`` and ``seq``
(order of insertion); the interchange files use the mixed-case field names and
order given by :data:`NODE_FIELDS` and :data:`EDGE_FIELDS`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the record types
NODE_TYPES = ("file", "class", "function", "interface", "variable")
RELATIONS = ("CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS")
REQUEST_RELATIONS = ("CALLS", "IMPORTS_FROM")
EXPORT_TYPES = ("named", "default", "none")
COMPLEXITIES = ("low", "medium", "high")
ENRICHERS = ("agent", "manual")
# fixed values: what is said of a semantic record that is not valid
SEMANTIC_ERRORS = (
    "semantic must be an object",
    "semantic.summary must be a string",
    'semantic.complexity must be "low" | "medium" | "high"',
    "semantic.domainConcepts must be an array",
    "semantic.enrichedAt must be a string",
    'semantic.enrichedBy must be "agent" | "manual"',
)

SEMANTIC_FIELDS = ("summary", "complexity", "domainConcepts", "enrichedAt", "enrichedBy")
NODE_FIELDS = ("id", "type", "name", "filePath", "startLine", "endLine", "exportType", "signature", "semantic")
EDGE_FIELDS = ("sourceId", "targetId", "relation", "sourceFile", "sourceLine")
METADATA_FIELDS = ("version", "nodeCount", "edgeCount", "fileCount", "createdAt")

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()


def _fields(names: tuple[str, ...], kinds: dict[str, T.DataType], lower: bool) -> list[T.StructField]:
    return [T.StructField(n.lower() if lower else n, kinds.get(n, _S)) for n in names]


def semantic_type(lower: bool = True) -> T.StructType:
    return T.StructType(_fields(SEMANTIC_FIELDS, {"domainConcepts": T.ArrayType(_S)}, lower))


def node_type(lower: bool = True) -> T.StructType:
    return T.StructType(_fields(NODE_FIELDS, {"startLine": _I, "endLine": _I, "semantic": semantic_type(lower)}, lower))


def edge_type(lower: bool = True) -> T.StructType:
    return T.StructType(_fields(EDGE_FIELDS, {"sourceLine": _I}, lower))


METADATA = T.StructType(_fields(METADATA_FIELDS, {"nodeCount": _L, "edgeCount": _L, "fileCount": _L}, lower=False))
_PLACE = [T.StructField("seq", _L), T.StructField("project", _S)]
NODES = T.StructType([*_PLACE, *node_type().fields])
EDGES = T.StructType([*_PLACE, *edge_type().fields])
FILES = T.StructType([T.StructField("seq", _L), T.StructField("project", _S), T.StructField("relpath", _S), T.StructField("ext", _S), T.StructField("lang", _S), T.StructField("content", _S)])


def to_interchange(nodes_or_edges, fields: tuple[str, ...]):
    """Columns renamed to the interchange names, in their order."""
    out = []
    for name in fields:
        if name == "semantic":
            inner = F.struct(*[F.col(f"semantic.{f.lower()}").alias(f) for f in SEMANTIC_FIELDS])
            out.append(F.when(F.col("semantic").isNotNull(), inner).alias("semantic"))
        else:
            out.append(F.col(name.lower()).alias(name))
    return nodes_or_edges.select(*out)


def semantic_error(semantic: Column) -> Column:
    """First thing wrong with a semantic record, or null.

    Checks run in a fixed order: the record, summary, complexity,
    domainConcepts, enrichedAt, enrichedBy.
    """
    get = semantic.getField
    return (
        F.when(semantic.isNull(), SEMANTIC_ERRORS[0])
        .when(get("summary").isNull(), SEMANTIC_ERRORS[1])
        .when(~F.coalesce(get("complexity").isin(*COMPLEXITIES), F.lit(False)), SEMANTIC_ERRORS[2])
        .when(get("domainconcepts").isNull(), SEMANTIC_ERRORS[3])
        .when(get("enrichedat").isNull(), SEMANTIC_ERRORS[4])
        .when(~F.coalesce(get("enrichedby").isin(*ENRICHERS), F.lit(False)), SEMANTIC_ERRORS[5])
    )


def domain_error(column: str, allowed: tuple[str, ...]) -> Column:
    """The value where it is outside its domain, else null."""
    return F.when(F.col(column).isNull() | ~F.col(column).isin(*allowed), F.coalesce(F.col(column), F.lit("null")))
