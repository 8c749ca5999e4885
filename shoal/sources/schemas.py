"""Schemas of the tables that are read and written."""

CORPUS = (
    "question_id long, title string, body string, comments array<struct<body: string>>, "
    "answers array<struct<body: string, comments: array<struct<body: string>>>>"
)
CLEANED = "id long, text string, title string"
TITLES = "question_id long, text string"
METADATA = "question_id long, title string, answer_count int, text_length int"
LABELS = "question_id long, cluster_id int"
SEARCH = "k int, dbi double, inertia double, seconds double, is_new_best boolean"
