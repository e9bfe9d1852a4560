-- lens_papers
SELECT doc_id AS pos,
  CASE WHEN doc_id % 50 = 0 THEN NULL ELSE 'Paper ' || CAST(doc_id % 301 AS STRING) END AS title,
  CASE doc_id % 10
    WHEN 0 THEN 'https://github.com/org' || CAST(doc_id % 37 % 7 AS STRING) || '/repo' || CAST(doc_id % 37 AS STRING)
    WHEN 1 THEN 'https://github.com/org' || CAST(doc_id % 37 % 7 AS STRING) || '/repo' || CAST(doc_id % 37 AS STRING) || '.git'
    WHEN 2 THEN 'https://github.com/org' || CAST(doc_id % 37 % 7 AS STRING) || '/repo' || CAST(doc_id % 37 AS STRING) || '/blob/main/a.py'
    WHEN 3 THEN 'https://org' || CAST(doc_id % 37 % 7 AS STRING) || '.github.io/repo' || CAST(doc_id % 37 AS STRING)
    WHEN 4 THEN 'https://example.org/' || source
    WHEN 5 THEN '  '
    WHEN 6 THEN NULL
    WHEN 7 THEN 'https://github.com/org' || CAST(doc_id % 37 % 7 AS STRING) || '/repo' || CAST(doc_id % 37 AS STRING) || '/'
    WHEN 8 THEN 'https://github.com/' || source
    ELSE 'https://github.com/ORG' || CAST(doc_id % 37 % 7 AS STRING) || '/repo' || CAST(doc_id % 37 AS STRING)
  END AS repo,
  CASE doc_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN 'maybe' ELSE NULL END AS ground_truth
FROM documents

-- lens_files
WITH a AS (SELECT doc_id, text, lang, CAST(floor(sqrt(CAST(doc_id AS DOUBLE))) AS BIGINT) AS g FROM documents),
b AS (SELECT *, doc_id - g * g AS seq FROM a),
c AS (SELECT *, CASE WHEN seq < 24 THEN (seq + g * 5) % 24 ELSE 99 END AS slot FROM b)
SELECT 'org' || CAST(g % 7 AS STRING) || '/repo' || CAST(g AS STRING) AS repo_key, seq,
  CASE slot
    WHEN 0 THEN 'README.md' WHEN 1 THEN 'LICENSE' WHEN 2 THEN 'setup.py' WHEN 3 THEN 'pyproject.toml'
    WHEN 4 THEN 'docs/conf.py' WHEN 5 THEN 'docs/api/index.md' WHEN 6 THEN 'docs/guide.md' WHEN 7 THEN 'docs/README.md'
    WHEN 8 THEN 'src/data/clean.py' WHEN 9 THEN 'preprocess.py' WHEN 10 THEN 'tokenizer/bpe.py' WHEN 11 THEN 'main.py'
    WHEN 12 THEN 'examples/demo.py' WHEN 13 THEN 'notebooks/tour.ipynb' WHEN 14 THEN 'lib/core.go' WHEN 15 THEN 'lib/core.rs'
    WHEN 16 THEN 'lib/Core.java' WHEN 17 THEN 'lib/core.ts' WHEN 18 THEN 'native/core.cpp' WHEN 19 THEN 'tests/test_main.py'
    WHEN 20 THEN 'requirements.txt' WHEN 21 THEN 'Dockerfile' WHEN 22 THEN 'mkdocs.yml' WHEN 23 THEN 'scripts/run_all.sh'
    ELSE 'src/' || lang || '/mod_' || CAST(seq AS STRING) || '.py' END AS path,
  CASE WHEN slot = 20 AND g % 3 = 0 THEN ''
    WHEN slot = 0 AND g % 3 = 0 THEN '# Title' || chr(10) || 'intro' || chr(10) || '## Installation' || chr(10) || 'First clone the tree. ' || text
    WHEN slot = 0 AND g % 3 = 1 THEN 'Use pip install thing now' || chr(10) || text
    WHEN slot = 7 THEN '## Usage' || chr(10) || 'run the build ' || text
    WHEN slot = 2 THEN 'setup(name="pkg-' || CAST(g AS STRING) || '")' || chr(10)
    WHEN slot = 3 AND g % 2 = 0 THEN '[project]' || chr(10) || 'name = "proj-' || CAST(g AS STRING) || '"' || chr(10) || 'sphinx' || chr(10)
    WHEN slot = 4 THEN 'extensions = ["sphinx.ext.autodoc", "myst_parser"]' || chr(10)
    WHEN slot = 6 AND g % 2 = 1 THEN '# API reference' || chr(10) || 'Parameters and returns. ' || text
    WHEN slot = 11 AND g % 2 = 0 THEN '"""Module."""' || chr(10) || 'def run(x):' || chr(10) || '    """Args: x."""' || chr(10) || '    return x' || chr(10)
    WHEN slot = 11 THEN 'class A:' || chr(10) || '    """One."""' || chr(10) || chr(10) || '    def f(self):' || chr(10) || '        return 1' || chr(10)
    WHEN slot = 13 AND g % 4 = 0 THEN '{"cells": [{"cell_type": "code", "source": "' || replace(translate(text, chr(34) || chr(92) || chr(9) || chr(13), '    '), chr(10), chr(92) || 'n') || '", "id": 1, "outputs": [{"data": {"image/png": "' || repeat('iVBOR', 400) || '"}}]}, {"cell_type": "raw", "source": "left out"}, {"cell_type": "code", "source": " "}, {"cell_type": "markdown", "source": ["# Title' || chr(92) || 'n", "' || chr(92) || 'n", "  say so' || chr(92) || 'n"]}], "metadata": {}}'
    WHEN slot = 13 AND g % 4 = 1 THEN '{"cells": [], "metadata": {}}'
    WHEN slot = 13 AND g % 4 = 2 THEN '{"cells": [{"cell_type": "code", "source": ["import a' || chr(92) || 'n", "' || replace(translate(text, chr(34) || chr(92) || chr(9) || chr(13), '    '), chr(10), chr(92) || 'n') || '", ""], "id": 1}]}'
    WHEN slot = 14 THEN '// Run starts it' || chr(10) || 'func Run() {}' || chr(10)
    WHEN slot = 15 THEN '/// One' || chr(10) || '//! two' || chr(10)
    WHEN slot IN (16, 17, 18) THEN '/** Doc' || chr(10) || ' * @param x in' || chr(10) || ' */' || chr(10) || 'int f(int x);' || chr(10)
    ELSE text END AS content
FROM c

-- lens_meta
WITH a AS (SELECT DISTINCT CAST(floor(sqrt(CAST(doc_id AS DOUBLE))) AS BIGINT) AS g FROM documents)
SELECT 'org' || CAST(g % 7 AS STRING) || '/repo' || CAST(g AS STRING) AS repo_key,
  g * 13 % 500 AS stars, g * 7 % 90 AS forks, g % 11 = 0 AS archived,
  CASE g % 6 WHEN 0 THEN NULL WHEN 1 THEN 'No longer maintained, use X' ELSE 'A tool' END AS description,
  CASE WHEN g % 4 = 0 THEN 'NOASSERTION' WHEN g % 4 = 1 THEN NULL WHEN g % 4 = 2 THEN 'MIT' ELSE 'Apache-2.0' END AS spdx_id,
  CAST('2024-01-' || CASE WHEN g % 28 < 9 THEN '0' ELSE '' END || CAST(g % 28 + 1 AS STRING) || ' 00:00:00' AS TIMESTAMP) AS pushed_at
FROM a WHERE g % 9 <> 4

-- lens_activity
SELECT 'org' || CAST(user_id % 100 % 7 AS STRING) || '/repo' || CAST(user_id % 100 AS STRING) AS repo_key, event_id, ts,
  CASE event_type WHEN 'click' THEN 'commit' WHEN 'view' THEN 'issue' WHEN 'signup' THEN 'contributor' WHEN 'purchase' THEN 'release' ELSE 'tag' END AS kind,
  user_id AS actor, CASE WHEN value < 20 THEN 0 ELSE 1 END AS comments,
  CASE WHEN value < 5 THEN 'nightly' ELSE 'v' || CAST(event_id % 3 AS STRING) || '.' || CAST(event_id % 10 AS STRING) END AS tag_name
FROM events

-- lens_answers
SELECT l.doc_id AS pos, m.model, 1 AS pass,
  CASE WHEN l.doc_id % 17 = 0 THEN '' WHEN l.doc_id % 19 = 0 THEN '{"has": tru'
    WHEN l.doc_id % 29 = 0 THEN '{"has_usage_examples": true, "evidence": "e"} and so on'
    WHEN l.doc_id % 6 = 1 THEN '{' || CASE (l.doc_id + m.k) % 12 WHEN 11 THEN '"other": true' ELSE '"has_usage_examples": ' ||
      CASE (l.doc_id + m.k) % 12 WHEN 0 THEN '"false"' WHEN 1 THEN '"0"' WHEN 2 THEN 'false' WHEN 3 THEN '0' WHEN 4 THEN '[]' WHEN 5 THEN '{}' WHEN 6 THEN '""' WHEN 7 THEN 'null' WHEN 8 THEN '0.0' WHEN 9 THEN '-1' ELSE '[false]' END
      END || ', "evidence": "e", "example_types": ["notebook"]}'
    WHEN l.doc_id % 5 = 0 THEN '```json' || chr(10) || '{"has_usage_examples": ' || CASE WHEN (l.quality + m.k) % 2 = 1 THEN 'true' ELSE 'false' END || ', "evidence": "e", "example_types": ["notebook"]}' || chr(10) || '```'
    ELSE '{"has_usage_examples": ' || CASE WHEN l.quality = 1 OR (l.doc_id % 7 = 0 AND m.k = 2) THEN 'true' ELSE 'false' END || ', "evidence": "e", "example_types": ["CLI usage", "notebook"], "example_files": null}' END AS raw,
  l.doc_id % 900 + 100 AS prompt_tokens, l.doc_id % 50 AS completion_tokens, CASE WHEN m.k = 2 THEN 0 ELSE l.doc_id % 900 + 100 + l.doc_id % 50 END AS total_tokens
FROM labels l CROSS JOIN (SELECT 0 AS k, 'model-a' AS model UNION ALL SELECT 1, 'model-b' UNION ALL SELECT 2, 'model-c') m

-- lens_downloads
SELECT 'proj-' || CAST(g AS STRING) AS package, g * 100 AS last_month FROM (SELECT DISTINCT CAST(floor(sqrt(CAST(doc_id AS DOUBLE))) AS BIGINT) AS g FROM documents) a WHERE g % 4 = 0

-- lens_pages
SELECT 'org' || CAST(g % 7 AS STRING) || '/repo' || CAST(g AS STRING) AS repo_key,
  CASE WHEN g % 10 = 0 THEN '' ELSE 'https://org' || CAST(g % 7 AS STRING) || '.github.io/repo' || CAST(g AS STRING) || '/' END AS html_url
FROM (SELECT DISTINCT CAST(floor(sqrt(CAST(doc_id AS DOUBLE))) AS BIGINT) AS g FROM documents) a WHERE g % 5 = 0

-- lens_liveness
SELECT 'org' || CAST(g % 7 AS STRING) || '/repo' || CAST(g AS STRING) AS repo_key,
  CASE WHEN g % 9 = 4 THEN 404 WHEN g % 13 = 5 THEN NULL ELSE 200 END AS status
FROM (SELECT DISTINCT CAST(floor(sqrt(CAST(doc_id AS DOUBLE))) AS BIGINT) AS g FROM documents) a
