"""Rule tables for documents and connections as defaults: (pattern, label) in order, for lower-case text. Any other table can be given in their place (rules.rule_table)."""

# Kinds of documents that are valid as they are.
DOCUMENT_TYPES = [
    "correspondence", "court filing", "fbi report", "deposition", "grand jury transcript", "flight log", "financial record", "search warrant", "police report",
    "property record", "news article", "travel record", "email", "contact list", "photograph", "video", "government record",
]

# A told kind of document to a valid one.
DOCUMENT_TYPE_RULES = [
    ("correspondence|email|letter|memo|fax|internal memorandum|calendar|appointment|schedule", "correspondence"),
    ("court filing|court order|indictment|plea|subpoena|motion|docket", "court filing"),
    ("fbi|302|bureau", "fbi report"),
    ("deposition|interview transcript", "deposition"),
    ("grand jury", "grand jury transcript"),
    ("flight|manifest|aircraft", "flight log"),
    ("financial|bank|account|employment record", "financial record"),
    ("search warrant|seizure|elsur", "search warrant"),
    ("police|incident report|booking|prison|correctional|jail|inmate", "police report"),
    ("property|real estate", "property record"),
    ("news|press|article|magazine", "news article"),
    ("travel|passport|immigration", "travel record"),
    ("administrative|government|official|form|log|record|registry|certificate", "government record"),
]

# A told kind of connection to one of eighteen.
CONNECTION_RULES = [
    ("attorney.client|lawyer.client|legal.represent|defense.counsel|retained.*counsel|represent.*legal", "attorney-client"),
    ("co-defendant|co.conspirator|co-accused|conspirator", "co-defendant"),
    ("prosecutor.*v|adversar|opposing.*counsel|plaintiff.*defendant", "legal-adversary"),
    ("legal|judge|court|judicial|subpoena|witness.*testimony|counsel|attorney|lawyer", "legal-proceeding"),
    ("employ|hire[dr]|work.*for|subordinate|supervisor|staff|assistant|secretary|housekeeper|butler|pilot|chauffeur", "employer-employee"),
    ("business.*partner|co.founder|joint.venture|investor|shareholder|partner.*business", "business-partner"),
    ("colleague|co-worker|peer|collaborat|professional", "professional"),
    ("financial.*client|bank.*client|account.*holder|trustee|fiduciary|financial.*advis", "financial-client"),
    ("transaction|wire.*transfer|payment|donation|fund.*transfer|financial", "financial-transaction"),
    ("family|familial|spouse|sibling|parent|child|married|brother|sister|son|daughter|wife|husband|mother|father|nephew|niece|uncle|aunt", "family"),
    ("romantic|girlfriend|boyfriend|lover|dating|intimate|sexual.*partner", "romantic"),
    ("friend|social|acquaintance|dinner|party|guest|personal|cellmate|co.inmate|fellow.inmate|mentor", "friend-social"),
    ("travel|flight|companion|passenger|flew.*with", "travel-companion"),
    ("victim|perpetrator|accuser|accused|abuser|traffick", "victim-perpetrator"),
    ("recruit|procur|bring.*girl|introduce.*minor|groom", "recruitment"),
    ("politic|government|official|diplomat|campaign|donor.*politic|advocate|regulatory|oversight", "political"),
    ("correspond|letter|email|recipient|sender|phone|call|message|contact", "correspondence"),
    ("media|journalist|reporter|interview|article|press|informant", "media-coverage"),
]

# The kind of a document by its text.
TEXT_RULES = [
    (r"flight\s+log|manifest|passenger|aircraft|tail\s+number|teterboro", "flight log"),
    (r"deposition|testimony|sworn|under\s+oath|direct\s+examination|cross.?examination", "deposition"),
    (r"grand\s+jury|indictment|true\s+bill|presentment", "grand jury transcript"),
    (r"search\s+warrant|inventory|seized|raid", "search warrant"),
    (r"fbi|302|investigation|bureau|special\s+agent", "fbi report"),
    (r"email|correspondence|from:\s*\S|to:\s*\S|subject:\s*\S", "email"),
    (r"court|filing|motion|order|docket|plea", "court filing"),
    (r"financial|bank|wire\s+transfer|account|transaction", "financial record"),
    (r"contact|address\s+book|phone\s+number|rolodex", "contact list"),
    (r"property|real\s+estate|island|little\s+st", "property record"),
    (r"police|report|incident|complaint", "police report"),
]

# Kind and strength of a connection by the prose about it; the last that fits counts.
RELATION_RULES = [
    ("email|wrote|messag|corresponden", "correspondence", 2),
    ("met with|meeting|dinner|lunch|visit", "social", 2),
    ("business|financial|paid|invest|fund", "financial", 3),
    ("flew|flight|plane|jet|travel", "travel", 3),
    ("island|palm beach|manhattan|residence|house|home", "social", 2),
]
