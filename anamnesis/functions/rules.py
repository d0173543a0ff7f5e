"""Patterns, word lists and constants that results depend on. Nothing here is computed."""

from __future__ import annotations

# PII patterns in the order in which ties of position are broken, with what they are masked as
PII_PATTERNS = (
    (r"sk-proj-[a-zA-Z0-9_-]{20,}", "api_key"),
    (r"sk-ant-[a-zA-Z0-9_-]{20,}", "api_key"),
    (r"sk-[a-zA-Z0-9_-]{20,}", "api_key"),
    (r"pk_[a-zA-Z0-9_-]{20,}", "api_key"),
    (r"AKIA[A-Z0-9]{16}", "api_key"),
    (r"gsk_[a-zA-Z0-9]{20,}", "api_key"),
    (r"xai-[a-zA-Z0-9]{20,}", "api_key"),
    (r"ghp_[a-zA-Z0-9]{36}", "api_key"),
    (r"glpat-[a-zA-Z0-9_-]{20,}", "api_key"),
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "credit_card"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "ssn"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "email"),
    (r"\b\d{3}[\s.\-]?\d{3}[\s.\-]?\d{4}\b", "phone"),
    (r"(?i)(?:password|pwd|passwd|pass)\s*[:=]\s*\S+", "password"),
)

# Rewriting rules in order: pattern, template
REFORMULATIONS = (
    (r"(?i)^I\s+always\s+choose\s+(.+?)\s+over\s+(.+)$", "Preference: $1 over $2"),
    (r"(?i)^My\s+fav(?:orite|ourite)\s+(.+?)\s+is\s+(.+)$", "Favorite $1: $2"),
    (r"(?i)^I\s+prefer\s+(.+?)\s+for\s+(.+)$", "Preference: $1 for $2"),
    (r"(?i)^I\s+prefer\s+(.+)$", "Preference: $1"),
    (r"(?i)^I'?m\s+building\s+(.+)$", "Active project: $1"),
    (r"(?i)^I\s+am\s+building\s+(.+)$", "Active project: $1"),
    (r"(?i)^Currently\s+building\s+(.+)$", "Active project: $1"),
    (r"(?i)^I\s+live\s+in\s+(.+)$", "Location: $1"),
    (r"(?i)^I\s+speak\s+(.+)$", "Language: $1"),
    (r"(?i)^I\s+work\s+with\s+(.+)$", "Technology: $1"),
    (r"(?i)^I\s+use\s+(.+)$", "Tool/technology: $1"),
)

# Temporal phrases in order
TEMPORAL_PHRASES = (
    r"(?i)\byesterday\b",
    r"(?i)\btoday\b",
    r"(?i)\blast\s+week\b",
    r"(?i)\blast\s+month\b",
    r"(?i)\blast\s+year\b",
    r"(?i)\brecently\b",
    r"(?i)\bjust\s+now\b",
    r"(?i)\bthis\s+morning\b",
    r"(?i)\bthis\s+week\b",
    r"(?i)\bthis\s+month\b",
    r"(?i)\bin\s+(january|february|march|april|may|june|july|august|september|october|november|december)\b",
    r"(?i)\bin\s+20\d{2}\b",
    r"(?i)\b\d+\s+days?\s+ago\b",
    r"(?i)\b\d+\s+weeks?\s+ago\b",
    r"(?i)\b\d+\s+months?\s+ago\b",
)

# Categories in order of precedence, by substrings of the lower-cased text
CATEGORIES = (
    ("Identity", ("my name is", "i live in", "i am from", "i speak", "my email", "i was born")),
    ("ActiveProject", ("currently building", "working on", "my project", "i'm building", "the project uses", "our app")),
    ("Preference", ("i prefer", "i always use", "my favorite", "i always choose", "my go-to", "i recommend", "my preferred", "i like to use")),
    ("Fact", ("the speed of", "the population", "was invented", "is known for", "was founded", "according to")),
)

# Category: half-life in days, importance weight, activation decay
CATEGORY_PARAMETERS = (
    ("Identity", 365.0, 1.0, 0.3),
    ("Preference", 60.0, 0.8, 0.4),
    ("Fact", 30.0, 0.6, 0.5),
    ("ActiveProject", 14.0, 0.5, 0.5),
    ("Default", 7.0, 0.3, 0.5),
    ("Conversation", 3.0, 0.1, 0.7),
)

# Weight of the source of a text
SOURCE_WEIGHTS = ((1.0, ("document", "file", "code")), (0.7, ("claude-code", "mcp")), (0.5, ("conversation", "cli")), (0.0, ("enrichment", "child")))
OTHER_SOURCE_WEIGHT = 0.3

# Labels of texts by substrings
TEXT_LABELS = (
    ("temporal:recurring", ("every day", "every week", "every morning", "every night", "routine", "always", "usually", "regularly")),
    ("temporal:past", ("used to", "previously", "back then", "in the past", "formerly", "last month", "last year", "last week", "last november", "last december", "last january", "last february", "last march", "last april", "last may", "last june", "last july", "last august", "last september", "last october", "visited", "years ago", "months ago", "weeks ago")),
    ("temporal:future", ("plan to", "going to", "want to", "hope to", "considering", "next year", "next month", "next week", "upcoming", "deadline", "filing deadline", "due date", "due by", "submit by", "expires", "scheduled for")),
    ("temporal:current", ("right now", "currently", "these days", "at the moment", "this week")),
    ("action:learning", ("learning", "studying", "practicing", "jlpt", "fluent", "native speaker", "taking lessons", "course", "class", "hiragana", "katakana", "kanji")),
    ("memtype:preference_update", ("switched to", "switched from", "moved to", "migrated to", "now use", "now using", "replaced with", "changed to", "transitioned to")),
    ("memtype:intro", ("my name is", "i am a ", "i'm a ", "call me ", "i go by")),
)
FUTURE_WITH_DATE = ("deadline", "due", "filing", "expires", "scheduled", "upcoming", "submit")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# Labels of queries by substrings, in order; the two of languages are decided by the signals
LANGUAGE_WORDS = ("language", "languages", "lingu")
NATURAL_LANGUAGE = ("learning", "studying", "jlpt", "fluent", "native", "speak", "vocabulary", "grammar", "duolingo", "rosetta", "accent")
PROGRAMMING_LANGUAGE = ("prefer", "code", "program", "framework", "library", "develop", "compile", "script", "software", "typed")
QUERY_LABELS = (
    ("action:learning", ("learn", "study", "class", "course", "school", "jlpt", "fluent", "practicing", "lessons")),
    ("domain:work", ("work", "job", "career", "project", "office", "company")),
    ("topic:career", ("job", "career", "employer", "work at", "work for", "where do you work", "what do you do", "position")),
    ("topic:fitness", ("exercise", "run", "workout", "gym", "fitness")),
    ("topic:food", ("cook", "food", "eat", "recipe", "restaurant")),
    ("topic:music", ("music", "guitar", "piano", "song", "play")),
    ("topic:housing", ("live", "apartment", "house", "neighbor", "move")),
    ("topic:pets", ("pet", "cat", "dog", "animal")),
    ("memtype:preference", ("prefer", "favorite", "like best", "choose")),
    ("topic:travel", ("travel", "trip", "visit", "vacation")),
    ("topic:technology", ("code", "program", "tech", "software", "editor", "framework")),
    ("topic:tools:editor", ("editor", "ide", "coding tool", "neovim", "vim", "vscode", "text editor", "jetbrains", "emacs", "sublime", "helix", "zed")),
    ("topic:entertainment", ("read", "book", "reading")),
    ("topic:health", ("health", "doctor", "sick", "medical")),
)

# Words that are no entities though capitalised
COMMON_WORDS = tuple(
    """I Im Ive Ill Id The A An My We They He She It Its You Your Our Their His Her
    This That Thats These Those Which Who Whom But And Or So If In On At To For
    Of With By As From Into Up Out Over Is Was Are Am Be Been Being
    Do Did Does Doesnt Dont Didnt Has Have Had Hasnt Havent Can Cant Could Couldnt
    Will Wont Would Wouldnt Should Shouldnt May Might Must Not No Yes
    Just Now Then Also About After Before Because When Where How What Why
    Here Heres There Theres However Although Though While Since Until
    Still Yet Already Really Very Well Actually Basically Generally Usually Often
    Some Many Most Each Every Any All Sure Maybe Perhaps Overall Certainly
    First Second Third Next Last New Good Great Best Better
    Try Trying Think Thinking Like Looking Make Making Keep Take Taking Get Getting Let Lets
    Mon Tue Wed Thu Fri Sat Sun""".split()
)

# Relationships of facts in order: kind, pattern whose group is the object
RELATIONSHIPS = (
    ("works_at", r"(?:works?\s+at|working\s+at|started\s+at|starting\s+at|employed\s+at|joined|works?\s+for|employed\s+by)\s+(.+)"),
    ("lives_in", r"(?:lives?\s+in|living\s+in|moved\s+to|moving\s+to|based\s+in|relocated\s+to|relocating\s+to|resides?\s+in)\s+(.+)"),
    ("prefers", r"(?:prefers?\s+|preferring\s+|likes?\s+|uses?\s+|using\s+|switched\s+to\s+|switching\s+to\s+|chose\s+)(.+)"),
    ("part_of", r"(?:part\s+of|belongs?\s+to|member\s+of|component\s+of)\s+(.+)"),
)
SINGLE_VALUED = ("works_at", "lives_in")
FACT_VERBS = ("is", "are", "was", "were", "has", "have", "works", "lives", "uses", "prefers", "started", "joined", "switched", "moved", "visited", "learned", "practices", "runs", "built", "leads")
FACT_NOISE = ("all my ", "closer to ", "my daily ", "development work")

# Scoring of queries
DATABASE_WORDS = ("postgresql", "mysql", "clickhouse", "mongodb", "postgres", "redis", "sqlite", "oracle", "cassandra", "dynamodb")
PROGRAMMING_WORDS = ("rust", "python", " go ", "javascript", "typescript", "java ", "c++", "scala", "kotlin", "swift")
TEMPORAL_QUERY = ("yesterday", "today", "last week", "last month", "last year", "recently", "just now", "this morning", "this week", "this month", "days ago", "weeks ago", "months ago", "deadline", "upcoming", "when", "scheduled", "date", "due", "plan", "next week", "next month")
CURRENT_QUERY = ("currently", "now use", "now using", "switched to", "these days", "at the moment", "right now")

# Subjects that name no one
DEGENERATE_SUBJECTS = ("the user", "i", "me", "my", "us", "we", "the person", "daily routine", "my daily routine", "personal machine", "development work", "all my", "user", "someone", "this", "he", "she", "they", "it", "you", "him", "her", "them", "his", "its")
SUBJECT_PREPOSITIONS = ("to ", "at ", "from ", "in ", "with ", "for ")
SUBJECT_SKIP = ("The", "A", "An", "I", "My", "In", "At", "To", "From", "With", "For", "He", "She", "They", "It", "We", "You", "His", "Her", "Their", "Its", "This", "That", "User", "Person")

# Labels and the words whose vector stands for each, in order
PROTOTYPES = (
    ("topic:career", "career, employment, job, work position, company, hiring, promotion, salary, interview, resume, professional development"),
    ("topic:language:natural", "language learning, studying a language, vocabulary, grammar, fluency, bilingual, native speaker, accent, JLPT, Japanese, Spanish, French, German, Chinese, Korean, Mandarin, Hindi, Arabic, Portuguese, Italian, Russian, Dutch, Swedish, Turkish, Duolingo, Rosetta Stone, language exchange, speaking practice, translation"),
    ("topic:language:programming", "programming language, coding language, software language, Rust, Python, Go, JavaScript, TypeScript, Java, C++, C#, Ruby, Scala, Kotlin, Swift, Haskell, Elixir, Clojure, Erlang, compiled language, interpreted language, systems programming, scripting language, functional language, object-oriented, type system, framework"),
    ("topic:education", "education, school, university, college, class, classroom, lecture, studying, homework, degree, academic, course, teaching, student, professor, exam, grade"),
    ("topic:health", "health, medical, doctor, hospital, illness, medicine, treatment, diagnosis, symptoms, wellness, mental health, therapy"),
    ("topic:fitness", "fitness, exercise, running, gym, workout, yoga, training, marathon, cycling, swimming, sports, physical activity, stretching"),
    ("topic:housing", "housing, apartment, house, home, rent, mortgage, moving, relocation, neighborhood, real estate, roommate, lease"),
    ("topic:food", "food, cooking, restaurant, recipe, cuisine, meal, baking, diet, nutrition, vegetarian, kitchen, chef, eating"),
    ("topic:music", "music, instrument, guitar, piano, singing, concert, band, song, playlist, album, genre, musician, melody"),
    ("topic:technology", "technology, programming, software, code, developer, computer, app, framework, library, algorithm, debugging, API, database, system"),
    ("topic:tools:editor", "text editor, code editor, IDE, integrated development environment, Neovim, Vim, nvim, VSCode, VS Code, Visual Studio Code, JetBrains, IntelliJ, WebStorm, PyCharm, Emacs, Sublime Text, Atom, Helix, Zed, Nano, editor configuration, dotfiles, init.lua, vimrc"),
    ("topic:finance", "finance, money, budget, savings, investment, bank, credit, debt, tax, expense, income, financial planning"),
    ("topic:travel", "travel, trip, vacation, destination, flight, hotel, tourism, sightseeing, abroad, passport, backpacking, adventure"),
    ("topic:relationships", "relationships, partner, dating, family, friends, social, love, marriage, breakup, connection, communication"),
    ("topic:hobby", "hobby, craft, art, painting, photography, gardening, reading, collecting, woodworking, knitting, creative pursuit"),
    ("topic:entertainment", "entertainment, movie, film, television, show, series, streaming, gaming, video game, book, novel, podcast"),
    ("topic:pets", "pets, cat, dog, animal, veterinarian, adoption, puppy, kitten, fish, bird, pet care, feeding"),
    ("domain:work", "work, office, professional, business, meeting, deadline, project, team, manager, colleague, workplace, corporate"),
    ("domain:life", "personal life, daily routine, lifestyle, home life, household, chores, errands, family time, weekend, evening"),
    ("domain:social", "social, friends, gathering, party, community, event, meetup, networking, hangout, celebration"),
    ("domain:health", "health, wellness, self-care, medical, doctor visit, mental health, therapy, sleep, recovery, rest"),
    ("domain:creative", "creative, art, design, writing, music, craft, invention, expression, imagination, artistic"),
    ("action:learning", "learning, studying, practicing, training, course, tutorial, skill development, taking a class, researching, reading about, lesson, workshop"),
    ("action:building", "building, creating, developing, coding, constructing, making, implementing, engineering, architecting, designing"),
    ("action:planning", "planning, scheduling, organizing, preparing, strategizing, roadmap, timeline, goal setting, future, agenda"),
    ("action:moving", "moving, relocating, changing address, new apartment, packing, unpacking, settling in, neighborhood change"),
    ("action:exercising", "exercising, running, working out, training, gym session, yoga, cycling, swimming, physical activity"),
    ("action:leading", "leading, managing, supervising, directing, organizing team, delegation, mentoring, coordinating, decision making"),
    ("temporal:current", "currently, right now, at the moment, these days, presently, today, this week, this month"),
    ("temporal:past", "used to, previously, before, in the past, formerly, back then, years ago, when I was"),
    ("temporal:future", "plan to, going to, will, want to, hope to, considering, thinking about, next year, someday"),
    ("temporal:recurring", "every day, every week, every morning, regularly, routine, habit, always, usually, typically, each time"),
    ("memtype:preference", "prefer, like, love, enjoy, favorite, choice, rather, better, best, always choose, always use"),
    ("memtype:fact", "fact, is, has, was born, lives, works at, name is, age is, located in, known as"),
    ("memtype:goal", "goal, want to, aim, aspire, target, objective, plan to achieve, dream, ambition, working toward"),
    ("memtype:habit", "habit, routine, every day, always do, regular practice, ritual, pattern, custom, tendency"),
    ("memtype:intro", "my name is, I am, I'm a, introduction, identity, about me, call me, this is, who I am, self introduction, personal introduction"),
    ("sentiment:positive", "great, love, happy, excited, wonderful, amazing, enjoy, fantastic, thrilled, grateful, perfect, awesome"),
    ("sentiment:negative", "bad, hate, frustrated, annoyed, disappointed, terrible, struggle, difficult, problem, worried, stressed, upset"),
)
