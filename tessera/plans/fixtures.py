"""Small inline tables, in SQL that Spark and DuckDB both read; times are ISO strings and now is NOW."""

NOW = "2024-01-31 00:00:00"


def rows(columns: str, *values: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(values)}) AS t({columns})"


SESSIONS = rows(
    "id, name, owner, archived, is_important, message_count, created_at, updated_at, last_accessed, last_message_at",
    "('s1', 'Holiday plans', 'alice', false, false, 3, '2024-01-02 10:00:00', '2024-01-10 10:00:00', '2024-01-10 10:00:00', '2024-01-10 09:00:00')",
    "('s2', 'Keep this one', 'alice', true, false, 5, '2023-12-01 10:00:00', '2023-12-02 10:00:00', '2023-12-02 10:00:00', NULL)",
    "('s3', 'Old trash', 'alice', true, false, 2, '2023-11-01 10:00:00', '2023-11-02 10:00:00', '2023-11-02 10:00:00', NULL)",
    "('s4', 'Fresh', 'bob', false, false, 0, '2024-01-30 23:55:00', '2024-01-30 23:55:00', NULL, NULL)",
    "('s5', 'test', 'bob', false, false, 2, '2024-01-05 10:00:00', '2024-01-05 10:00:00', '2024-01-05 10:00:00', '2024-01-05 10:05:00')",
    "('s6', 'Incognito', 'bob', false, false, 1, '2024-01-30 10:00:00', '2024-01-30 10:00:00', '2024-01-30 10:00:00', NULL)",
    "('s7', 'Vital', 'bob', true, true, 1, '2023-10-01 10:00:00', '2023-10-01 10:00:00', '2023-10-01 10:00:00', NULL)",
    "('s8', 'No owner', NULL, NULL, false, 25, '2023-09-01 10:00:00', NULL, '2023-09-05 10:00:00', NULL)",
    "('s9', 'Long one', 'alice', true, false, 30, '2023-09-01 10:00:00', '2023-09-05 10:00:00', '2023-09-05 10:00:00', NULL)",
    "('s10', 'Empty old', NULL, false, false, 0, '2024-01-01 10:00:00', '2024-01-01 10:00:00', '2024-01-01 10:00:00', NULL)",
)
MESSAGES = rows(
    "id, session_id, role, content, ts",
    "('m1', 's1', 'user', 'Where should we go for the long summer holiday this year, any ideas?', '2024-01-10 08:58:00')",
    "('m2', 's1', 'assistant', 'A week at the coast would be calm, and the foo_bar cabin is free in July.', '2024-01-10 08:59:00')",
    "('m3', 's1', 'user', 'Please remember that I prefer mountains over beaches and early trains.', '2024-01-10 09:00:00')",
    "('m4', 's5', 'user', 'hi', '2024-01-05 10:04:00')", "('m5', 's5', 'assistant', 'Hello! fooXbar', '2024-01-05 10:05:00')",
    "('m6', 's3', 'user', 'write hi to a friend', '2023-11-02 10:00:00')", "('m7', 's3', 'assistant', 'Hi!', '2023-11-02 10:00:00')",
    "('m8', 's2', 'tool', NULL, '2023-12-02 10:00:00')", "('m9', 's6', 'user', 'secret question', '2024-01-30 10:00:00')",
    "('m10', 's8', 'system', 'You are helpful. Café au lait, AI email.', '2023-09-05 10:00:00')",
)
DOCUMENTS = rows(
    "id, session_id, title, language, content, version_count, archived, owner, created_at, updated_at",
    "('d1', 's1', 'Plan', 'markdown', '# Plan' || chr(10) || 'A longer body of text that says what to do next week.', 3, false, 'alice', '2024-01-01 00:00:00', '2024-01-05 00:00:00')",
    "('d2', 's1', 'Import', NULL, '<!-- pdf_source upload_id=\"abc\" --> Same body of text in both copies of the file.', 1, NULL, 'alice', '2024-01-02 00:00:00', NULL)",
    "('d3', NULL, ' import ', NULL, '<!-- pdf_source upload_id=\"xyz\" -->  Same body of text in both copies of the file.', 1, false, 'alice', '2024-01-03 00:00:00', NULL)",
    "('d4', 's5', 'test', 'text', 'whatever this may be, the title decides here', 1, false, 'bob', '2024-01-02 00:00:00', '2024-01-02 00:00:00')",
    "('d5', 's5', 'Empty', NULL, '   ', 1, false, 'bob', '2024-01-02 00:00:00', NULL)",
    "('d6', NULL, 'Reply', 'email', '> quoted line one' || chr(10) || '> quoted line two' || chr(10) || 'On Monday Ann wrote:' || chr(10) || 'ok', 1, false, 'bob', NULL, NULL)",
    "('d7', 's9', 'Note', 'python', 'short', 9, true, NULL, '2024-01-04 00:00:00', '2024-01-06 00:00:00')",
    "('d8', 's8', 'New email', 'email', 'To: ' || chr(10) || 'Subject: (empty)' || chr(10) || '---', 1, false, 'alice', '2024-01-04 00:00:00', NULL)",
    "('d9', 's8', 'Untitled', NULL, 'One single line of text that is quite long enough to be kept by both tidy rules.', 2, false, 'alice', '2024-01-07 00:00:00', NULL)",
)
IMAGES = rows(
    "id, owner, tags, ai_tags, album_id, favorite, file_hash, file_size, model, created_at",
    "(1, 'alice', 'cat, Dog , ,cat', 'animal', 1, true, 'h1', 1000, 'm-a', '2024-01-01 00:00:00')", "(2, 'alice', '', NULL, 1, false, 'h2', 2500, 'm-b', '2024-01-02 00:00:00')",
    "(3, 'bob', 'Cat,sea', 'sea,Sky', 2, false, 'h1', NULL, NULL, '2024-01-03 00:00:00')", "(4, 'alice', NULL, 'dog', NULL, true, 'h1', 700, 'm-a', '2024-01-04 00:00:00')",
)
EVENTS = rows(
    "uid, calendar, owner, summary, dtstart, dtend, status, rrule",
    "('e1', 'home', 'alice', 'Dentist appointment', '2024-01-31 09:00:00', '2024-01-31 10:00:00', 'confirmed', '')", "('e2', 'home', 'alice', 'Night train', '2024-01-30 22:00:00', '2024-01-31 06:00:00', 'confirmed', '')",
    "('e3', 'work', 'bob', 'Client demo', '2024-02-02 00:00:00', '2024-02-02 01:00:00', 'confirmed', '')", "('e4', 'work', 'bob', 'Standup', '2024-02-07 00:00:00', '2024-02-07 00:15:00', 'cancelled', 'FREQ=WEEKLY;COUNT=5')",
    "('e5', 'home', 'alice', 'Surgery', '2024-02-07 00:00:00', '2024-02-07 12:00:00', 'confirmed', '')", "('e6', 'home', 'alice', 'dentist APPOINTMENT', '2024-01-31 09:00:00', '2024-01-31 09:30:00', 'confirmed', '')",
    "('e7', 'home', 'alice', 'Walk', '2024-01-01 08:00:00', '2024-01-01 09:00:00', 'confirmed', 'FREQ=DAILY;UNTIL=20240203T080000Z')", "('e8', 'work', 'bob', 'Retro', '2024-01-15 08:00:00', '2024-01-15 09:00:00', 'confirmed', 'FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,WE')",
    "('e9', 'work', 'bob', 'Broken', '2024-01-31 08:00:00', '2024-01-31 09:00:00', 'confirmed', 'FREQ=SOMETIMES')",
)
MEMORIES = rows(
    "id, text, category, ts, owner, session_id",
    "('k1', 'Her phone number is 555 0100', 'contact', 1706000000, 'alice', 's1')", "('k2', 'likes green tea and long walks', 'preference', 1705000000, 'alice', 's1')",
    "('k3', 'Anna Berg is the landlord', 'identity', 1704000000, 'alice', NULL)", "('k4', 'todo: renew the passport before the deadline', 'task', 1706500000, 'bob', 's5')",
    "('k5', 'the project deploys python services with docker', 'fact', 1700000000, 'alice', 's9')", "('k6', ' LIKES green tea and long walks ', 'fact', 1706100000, 'bob', 'zz')",
    "('k7', 'green tea and long walks are what she likes', 'fact', NULL, NULL, NULL)",
)
PULLS = rows(
    "number, title, files, merge_state, review_decision, updated_at",
    "(1, 'Fix token refresh in login flow', 'auth/login.py,auth/token.py', 'clean', 'approved', '2024-01-30 00:00:00')", "(2, 'Fix token refresh for login flow', 'auth/login.py,auth/token.py,docs/a.md', 'dirty', '', '2024-01-20 00:00:00')",
    "(3, 'Vector memory retrieval migration', 'mem/vector.py', 'unknown', 'changes_requested', '2023-12-01 00:00:00')", "(4, 'Docs', 'docs/a.md', 'clean', 'review_required', '2024-01-29 00:00:00')",
    "(5, 'Database privacy leak', 'db/x.py,mem/vector.py', '', 'none', '2024-01-10 00:00:00')", "(6, 'No files at all', '', 'clean', '', NULL)",
)
CONTACTS = rows(
    "id, name, emails, phones", "(1, 'Ann', 'ann@x.org;Ann@Work.com', '1;2;3')", "(2, 'Bob', 'bob@x.org', '')", "(3, 'Cy', '', '')", "(4, 'Annie', 'ANN@x.org', '9')",
)
TASKS = rows(
    "id, then_id, owner, status, next_run, schedule, clock, day", "(1, 2, 'alice', 'active', '2024-01-30 23:00:00', 'daily', '09:30', NULL)", "(2, 3, 'alice', 'active', '2024-02-01 00:00:00', 'weekly', '08:00', 2)",
    "(3, 1, 'bob', 'paused', '2024-01-01 00:00:00', 'monthly', '07:00', 31)", "(4, 5, 'bob', 'active', NULL, 'daily', '9am', NULL)", "(5, NULL, 'bob', 'active', '2024-01-31 00:00:00', 'monthly', '00:00', 30)",
)
WEB = rows(
    "id, title, url, snippet, age",
    "(1, 'Latest news from Sweden', 'https://www.bbc.com/sweden', 'Breaking news from Sweden today with daily coverage', '2024-01-29')", "(2, 'Sweden beat rivals in hockey championship', 'https://sports.yahoo.com/x', 'The sports pages on Sweden', '2024-01-10')",
    "(3, 'Transport policy', 'https://transport.gov/se', 'Sweden moves freight to rail', '2023-06-01')", "(4, 'My page', 'https://facebook.com/me', '', NULL)", "(5, 'Archive', 'https://archive.org/sweden', 'An old archive about many lands', '2025-01-01')", "(6, NULL, NULL, NULL, 'soon')",
)
SKILLS = rows(
    "name, description, when_to_use, tags, procedure, status, source, confidence, uses, platforms, needs, fallback",
    "('deploy-docker', 'Deploy a service with docker', 'when a release is due', 'docker,deploy', 'build,push,run', 'published', 'user', '0.9', 3, '', 'shell', '')",
    "('deploy-docker-2', 'Deploy a service with docker', 'when a release is due', 'docker', 'build,push', 'draft', 'teacher-escalation', 'abc', 0, 'linux', '', '')",
    "('bake-bread', 'Bake bread at home', 'weekends', 'food', 'mix,wait,bake', 'draft', 'user', NULL, 1, '', '', 'web')", "('old', 'Retired', '', '', '', 'archived', 'user', '1', 0, '', '', '')",
)
