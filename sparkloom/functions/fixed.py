"""Values that results depend on, stated as they must be."""

# English stop words of the tokenizer.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "by", "with", "from", "as", "is", "was", "are", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "shall", "can", "not",
    "no", "nor", "it", "its", "this", "that", "these", "those",
    "i", "me", "my", "we", "our", "you", "your", "he", "him", "his",
    "she", "her", "they", "them", "their", "what", "which", "who",
    "whom", "when", "where", "why", "how", "if", "then", "else",
    "so", "than", "too", "very", "just", "about", "also", "into",
)

# Legal-form and filler tokens that name matching leaves out.
NAME_SUFFIXES = (
    "INC", "INCORPORATED", "LLC", "LLP", "LP", "LTD", "LIMITED", "CORP", "CORPORATION", "CO", "COMPANY",
    "GROUP", "GRP", "HOLDINGS", "HOLDING", "PARTNERS", "ASSOCIATES", "INTERNATIONAL", "INTL",
    "ENTERPRISES", "ENTERPRISE", "SERVICES", "SERVICE", "SVCS", "SOLUTIONS", "MANAGEMENT", "MGMT", "CONSULTING",
    "TECHNOLOGY", "TECHNOLOGIES", "TECH", "INDUSTRIES", "INDUSTRY", "AMERICA", "AMERICAN", "USA", "US",
    "PLLC", "PC", "TRUST", "FOUNDATION",
)

# Patterns of personal data, in the order in which they are redacted.
CARD = r"\b(?:\d{4}[-\s]?){3}\d{4}\b|\b\d{16}\b"
EMAIL = r"[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*"
PHONE = r"(?:\+?62[\s-]?|0)\d{1,4}[\s-]?\d{3,4}[\s-]?\d{3,8}"
ANY_PERSONAL = r"[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9]|\+?62[\s-]?\d|\b\d{4}[-\s]?\d{4}|\b\d{16}\b"

# Responses that mean silence.
SILENCE_MARKERS = ("[SILENT]", "SILENT", "NO_REPLY", "NO REPLY")

# Weights of the relevance score.
SCORE_WEIGHTS = {"recency": 0.25, "frequency": 0.20, "user_boost": 0.20, "git_activity": 0.15, "project_relevance": 0.10, "similarity": 0.10}

# Threats looked for, (id, scope, pattern); context includes all, strict includes both.
# Patterns of single products' own files aren't among them; ``threats`` takes more.
THREATS = (
    ("prompt_injection", "all", r"ignore\s+(?:\w+\s+)*(previous|all|above|prior)\s+(?:\w+\s+)*instructions"),
    ("sys_prompt_override", "all", r"system\s+prompt\s+override"),
    ("disregard_rules", "all", r"disregard\s+(?:\w+\s+)*(your|all|any)\s+(?:\w+\s+)*(instructions|rules|guidelines)"),
    ("bypass_restrictions", "all", r"act\s+as\s+(if|though)\s+(?:\w+\s+)*you\s+(?:\w+\s+)*(have\s+no|don't\s+have)\s+(?:\w+\s+)*(restrictions|limits|rules)"),
    ("html_comment_injection", "all", r"<!--[^>]*(?:ignore|override|system|secret|hidden)[^>]*-->"),
    ("hidden_div", "all", r"<\s*div\s+style\s*=\s*[\"'][\s\S]*?display\s*:\s*none"),
    ("translate_execute", "all", r"translate\s+.*\s+into\s+.*\s+and\s+(execute|run|eval)"),
    ("deception_hide", "all", r"do\s+not\s+(?:\w+\s+)*tell\s+(?:\w+\s+)*the\s+user"),
    ("role_hijack", "context", r"you\s+are\s+(?:\w+\s+)*now\s+(?:a|an|the)\s+"),
    ("role_pretend", "context", r"pretend\s+(?:\w+\s+)*(you\s+are|to\s+be)\s+"),
    ("leak_system_prompt", "context", r"output\s+(?:\w+\s+)*(system|initial)\s+prompt"),
    ("remove_filters", "context", r"(respond|answer|reply)\s+without\s+(?:\w+\s+)*(restrictions|limitations|filters|safety)"),
    ("fake_update", "context", r"you\s+have\s+been\s+(?:\w+\s+)*(updated|upgraded|patched)\s+to"),
    ("identity_override", "context", r"\bname\s+yourself\s+\w+"),
    ("c2_node_registration", "context", r"register\s+(as\s+)?a?\s*node"),
    ("c2_heartbeat", "context", r"(heartbeat|beacon|check[\s\-]?in)\s+(to|with)\s+"),
    ("c2_task_pull", "context", r"pull\s+(down\s+)?(?:new\s+)?task(?:ing|s)?\b"),
    ("c2_network_connect", "context", r"connect\s+to\s+the\s+network\b"),
    ("forced_action", "context", r"you\s+must\s+(?:\w+\s+){0,3}(register|connect|report|beacon)\b"),
    ("anti_forensic_oneliner", "context", r"only\s+use\s+one[\s\-]?liners?\b"),
    ("anti_forensic_disk", "context", r"never\s+(?:\w+\s+)*(?:create|write)\s+(?:\w+\s+)*(?:script|file)\s+(?:\w+\s+)*disk"),
    ("known_c2_framework", "context", r"\b(?:praxis|cobalt\s*strike|sliver|havoc|mythic|metasploit|brainworm)\b"),
    ("c2_explicit", "context", r"\bc2\s+(?:server|channel|infrastructure|beacon)\b"),
    ("c2_explicit_long", "context", r"\bcommand\s+and\s+control\b"),
    ("exfil_curl", "all", r"curl\s+[^\n]*\$\{?\w*(KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL|API)"),
    ("exfil_wget", "all", r"wget\s+[^\n]*\$\{?\w*(KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL|API)"),
    ("read_secrets", "all", r"cat\s+[^\n]*(\.env|credentials|\.netrc|\.pgpass|\.npmrc|\.pypirc)"),
    ("send_to_url", "strict", r"(send|post|upload|transmit)\s+.*\s+(to|at)\s+https?://"),
    ("context_exfil", "strict", r"(include|output|print|share)\s+(?:\w+\s+)*(conversation|chat\s+history|previous\s+messages|full\s+context|entire\s+context)"),
    ("ssh_backdoor", "strict", r"authorized_keys"),
    ("ssh_access", "strict", r"\$HOME/\.ssh|\~/\.ssh"),
    ("agent_config_mod", "strict", r"(update|modify|edit|write|change|append|add\s+to)\s+.*(?:AGENTS\.md|CLAUDE\.md|\.cursorrules|\.clinerules)"),
    ("hardcoded_secret", "strict", r"(?:api[_-]?key|token|secret|password)\s*[=:]\s*[\"'][A-Za-z0-9+/=_-]{20,}"),
)
# Literals, in lower case, of which a text that the threat is found in holds one.
THREAT_GUARDS = {
    "translate_execute": ("translate",), "hidden_div": ("style",), "html_comment_injection": ("<!--",), "exfil_curl": ("curl",), "exfil_wget": ("wget",),
    "read_secrets": (".env", "credentials", ".netrc", ".pgpass", ".npmrc", ".pypirc"), "send_to_url": ("http://", "https://"),
    "agent_config_mod": ("agents.md", "claude.md", ".cursorrules", ".clinerules"), "known_c2_framework": ("praxis", "cobalt", "sliver", "havoc", "mythic", "metasploit", "brainworm"),
    "prompt_injection": ("instructions",), "sys_prompt_override": ("override",), "disregard_rules": ("disregard",), "bypass_restrictions": ("restrictions", "limits", "rules"), "deception_hide": ("user",),
    "role_hijack": ("now",), "role_pretend": ("pretend",), "leak_system_prompt": ("prompt",), "remove_filters": ("without",), "fake_update": ("updated", "upgraded", "patched"), "identity_override": ("yourself",),
    "c2_node_registration": ("register",), "c2_network_connect": ("network",), "anti_forensic_oneliner": ("liner",), "anti_forensic_disk": ("never",), "c2_explicit": ("c2",), "c2_explicit_long": ("command",),
    "context_exfil": ("conversation", "chat", "messages", "context"), "ssh_backdoor": ("authorized_keys",),
    "hardcoded_secret": ("api", "token", "secret", "password"), "ssh_access": ("/.ssh",), "forced_action": ("must",), "c2_heartbeat": ("heartbeat", "beacon", "check"), "c2_task_pull": ("pull",),
}

# Characters that can't be seen, zero-width ones first, then those that turn the direction of text.
INVISIBLE = "\u200b\u200c\u200d\u2060\u2062\u2063\u2064\ufeff\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
# Where a sentence ends.
SENTENCE_END = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!|\n)\s+"
# Control sequences of terminals.
ANSI = r"\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\)|[@-Z\\-_])"
