"""Vocabularies and limits shared by the operators.

Fixed values: they must equal the source system's for results to agree.
"""

ENTITY_TYPES = [
    "Company", "Person", "Product", "Contract",
    "Location", "Technology", "Policy", "Regulation",
]

RELATIONSHIP_TYPES = [
    "WORKS_FOR", "OWNS", "USES", "BELONGS_TO", "RENEWS",
    "EXPIRES_ON", "LOCATED_IN", "DEPENDS_ON", "SELLS_TO", "GOVERNED_BY",
]

# (name, parent)
DEFAULT_CLASSES = [
    ("Entity", None),
    ("Person", "Entity"),
    ("Organization", "Entity"),
    ("Location", "Entity"),
    ("Concept", "Entity"),
]

# (predicate, source position, target position, confidence, evidence)
RELATION_TEMPLATES = [
    ("WORKS_FOR", 0, 1, 0.92, "Mock: person works for company"),
    ("USES", 1, 2, 0.88, "Mock: company uses technology"),
    ("LOCATED_IN", 0, 3, 0.85, "Mock: entity is located in location"),
    ("GOVERNED_BY", 1, 4, 0.80, "Mock: entity governed by regulation"),
    ("DEPENDS_ON", 2, 1, 0.75, "Mock: technology depends on product"),
]

RUN_STEPS = [
    "entity_extraction", "relationship_discovery", "ontology_builder",
    "graph_update", "vector_memory",
]

# who decides in each step, as written to the decision log
RUN_AGENTS = {
    "entity_extraction": "EntityExtractionAgent", "relationship_discovery": "RelationshipDiscoveryAgent",
    "ontology_builder": "OntologyBuilderAgent", "graph_update": "GraphUpdateAgent", "vector_memory": "VectorMemoryAgent",
}

# extension -> MIME type of the formats that may be ingested
SUPPORTED_MIME = {
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".doc": "application/msword",
}

NODE_CAP = 60
EDGE_CAP = 80
CONTEXT_CAP = 30
FIND_LIMIT = 50
DEFAULT_CONFIDENCE = 0.8
SNIPPET_CHARS = 300

# chunking presets: (max tokens, overlap tokens)
EMBED_WINDOW = (1000, 100)
ENTITY_WINDOW = (600, 50)
RELATION_WINDOW = (800, 100)
WORD_TOKEN_RATIO = 1.3

# whitespace as Python's str.split() sees it, as a regex character class body
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# C0/C1 control characters other than newline and tab
CONTROL_CLASS = r"\x00-\x08\x0b-\x1f\x7f-\x{9f}"

URL_PATTERN = rf"https?://[^{SPACE_CLASS}]+"
EMAIL_PATTERN = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[a-z]{2,}"

# frequent function words per language, for the stop-word language vote
STOP_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "den", "von", "zu", "mit", "nicht",
           "ein", "eine", "im", "für", "auf", "sich", "dem", "auch"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was",
           "on", "are", "with", "as", "by", "this", "be", "at"],
    "es": ["el", "la", "los", "de", "que", "y", "en", "un", "una", "es",
           "por", "con", "del", "las", "para", "se", "no", "como"],
    "fr": ["le", "la", "les", "de", "des", "et", "en", "un", "une", "du",
           "est", "que", "dans", "pour", "qui", "sur", "avec", "au"],
}

NO_SOURCES_MESSAGE = "No relevant documents found in the knowledge base for this question."
NO_CONTEXT_MESSAGE = (
    "I could not find relevant information in the knowledge graph or document corpus "
    "to answer this question. Try ingesting and processing documents first."
)
