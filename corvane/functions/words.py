"""Fixed values that results depend on."""

# General stopwords, in natural order.
STOPWORDS = (
    "a about above after again against all am an and any are aren as at be because been before being below between both but by can cannot could couldn "
    "did didn do does doesn doing don down during each few for from further had hadn has hasn have haven having he her here hers herself him himself his how "
    "i if in into is isn it its itself just me more most must my myself no nor not now of off on once only or other ought our ours ourselves out over own same "
    "shan she should shouldn so some such than that the their theirs them themselves then there these they this those through to too under until up very was "
    "wasn we were weren what when where which while who whom why will with won would wouldn you your yours yourself yourselves"
).split()
# Stopwords of the reranker.
RERANK_STOPWORDS = (
    "a about an and any are as at be been being but by can could did do does for from had has have how i if in into is it its just may me more most my no not "
    "of on or our over shall should so some such than that the their them then there these they this those to too under up was we were what when where which "
    "who why will with would you your"
).split()
# Stopwords of the answerer.
ANSWER_STOPWORDS = (
    "a an and are as at be been but by can could did do does for from had has have how i if in into is it its may me my of on or our shall should so than that "
    "the their them then there these they this those to was we were what when where which who whom why will with would you your"
).split()
# Stopwords of the support check, with words of attribution.
SUPPORT_STOPWORDS = (
    "a about above after all also am an and any are as at be because been before being below but by can could did do does doing done during each few for from "
    "further had has have having he her here hers him his how i if in into is it its itself just let me might more most must my no nor not note now of off on "
    "once only or other our out over own please same she should so some such than that the their them then there these they this those through to too under "
    "until up us very was we were what when where which while who whom why will with would you your according based follow following follows found know say "
    "said says see seen tell"
).split()
# Stopwords of quotes.
QUOTE_STOPWORDS = (
    "a about after all also an and any are as at be been before being but by can could did do does for from had has have he her his how i if in into is it its "
    "may might more most must no not of on only or other our over own same she should so some such than that the their then there these they this those to too "
    "us very was we were what when where which who why will with would you your"
).split()
# Words that ask.
SCAFFOLD = (
    "how what when where which who whom whose why many much long soon often need needs needed see sees point does do did is are was were can could should would "
    "will list give tell explain describe happen happens"
).split()
# Suffix, what takes its place; the first that leaves three letters counts.
SUFFIXES = (
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("ations", "ate"), ("ements", "ement"), ("ities", "ity"), ("ation", "ate"), ("ings", ""), ("ies", "y"),
    ("ied", "y"), ("ing", ""), ("ers", ""), ("ly", ""), ("er", ""), ("ed", ""), ("es", ""), ("s", ""),
)
# Words that ask for an amount of money; patterns of money and of "free".
PRICE_WORDS = "cost costs price prices pricing fee fees charge charges expensive tariff".split()
MONEY = r"[$€£]|\b(?:dollars?|usd|eur|euros?|gbp|pounds?|cents?|percent|percentage)\b"
FREE = (
    r"\b(?:free of charge|at no (?:\w+ )?(?:cost|charge|premium|expense)|no (?:\w+ )?(?:cost|charge|premium|fee|fees) (?:to|for) (?:the )?employee"
    r"|no (?:employee|additional|extra) (?:cost|charge|premium|fee|fees)|complimentary|fully (?:covered|paid)|covered in full)\b"
)
# Words that continue a conversation.
OPENERS = ("and", "also", "but", "so", "then", "plus")
OPENING_PHRASES = ("what about", "how about", "and what about", "what if")
# Prefixes of identifiers that mean the same.
PREFIXES = {"version": "v", "ver": "v", "rev": "v", "revision": "v"}
# Brackets that count as square ones.
BRACKETS = ("【】［］⟦⟧❨❩", "[][][][]")

# Fixed value: lines that state nothing: headings, anchors, fences, table rules, lone tags.
NOTHING_STATED = r"^\s*(?:#{1,6}\s|\{\s*#[\w-]+\s*\}|```|\|?\s*[:-]{3,}\s*\||<[^>]+>\s*$)"
