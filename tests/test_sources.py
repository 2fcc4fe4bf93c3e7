"""Extraction from small hand-written repositories."""

from __future__ import annotations

import json

import pytest

from loomstrata.functions import lexer
from loomstrata.sources import repository as R

EXPRESS = {
    "package.json": json.dumps({"dependencies": {"express": "^4.18.0"}, "devDependencies": {"jest": "29"}}),
    "app.js": """
        const express = require('express'); // require('./commented')
        const users = require("./routes/users");
        const app = express();
        app.set('port', 3000); app.get('port');
        app.use('/static', express.static('public'));
        app.use('/api/users', users);
        app.use('/v', require('./routes/api'));
        app.get('/health', function (req, res) { res.send(`ok ${'}'}`); });
        const re = /app\\.get\\('\\/no', x\\)/g;
    """,
    "routes/users.js": """
        const router = require('express').Router();
        function listUsers(req, res) {}
        async function createUser(req, res) {}
        router.route('/').get(listUsers).post(createUser);
        router.delete('/:id', (req, res) => {});
        promise.get('/nope', listUsers);
        module.exports = router;
    """,
    "routes/api/index.js": "const router = x(); router.use('/v1', require('./ping')); module.exports = router;",
    "routes/api/ping.js": "import foo from '../users.js'; import '../../app'; export * from './other'; router.get('/ping', pong); function pong() {}",
    "tests/app.test.js": "app.get('/t', x)",
    "src/view.tsx": "export const x = 1",
    "node_modules/a/index.js": "app.get('/x', y)",
    ".hidden/z.js": "app.get('/x', y)",
    "lib/user.spec.js": "1",
}
NEST = {
    "package.json": json.dumps({"dependencies": {"express": "4", "@nestjs/core": "^10"}}),
    "tsconfig.json": '{ // comment\n "extends": "./tsconfig.base.json", "compilerOptions": {"paths": {"@app/*": ["src/app/*"], "@app/special": ["src/special.ts"],}} }',
    "tsconfig.base.json": '{"compilerOptions": {"baseUrl": "."}}',
    "src/users.controller.ts": """
        import { Controller, Get } from '@nestjs/common';
        import { UsersService } from './users.service';
        import { Deep } from '@app/deep';
        import special from '@app/special';
        @Controller({ path: 'users', version: '1' })
        export class UsersController implements OnModuleInit, Typed<string> {
          private readonly log = new Logger(UsersController.name);
          constructor(private readonly users: UsersService) {}
          @Get(':id')
          @Header('x', 'y')
          async findOne(@Param('id') id: string): Promise<{ a: number }> { return this.users.find(id); }
          @Post()
          create() { if (true) { return 1; } }
          helper(): void {}
        }
    """,
    "src/users.service.ts": "@Injectable() export class UsersService { @Get('x') find(id) { return id } }\nfunction free() {}",
    "src/app/deep.ts": "@Controller(['v1/deep', 'v2']) export class Deep { @All() any() {} }",
    "src/special.ts": "@Controller(PREFIX)\nexport default class S { @Put('/z/') z() {} }",
    "src/users.service.spec.ts": "class T {}",
}


@pytest.fixture(scope="module")
def trees(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("trees")
    for repo, files in (("exp", EXPRESS), ("nst", NEST)):
        for path, text in files.items():
            at = root / repo / path
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
    (root / "jvm").mkdir()
    (root / "jvm" / "pom.xml").write_text("<a>spring-boot</a>")
    return R.read_tree(spark, str(root)).cache()


def test_detect(trees):
    assert {r["repo_name"]: (r["framework"], r["version"]) for r in R.detect(trees).collect()} == {"exp": ("express", "^4.18.0"), "nst": ("nestjs", "^10"), "jvm": ("spring", None)}
    assert not R.sizes_mb(trees).filter("too_large").collect()


def test_express(trees):
    t = R.parse(trees.filter("repo_name = 'exp'"), "express")
    assert {r["path"] for r in t["modules"].collect()} == {"app.js", "routes/users.js", "routes/api/index.js", "routes/api/ping.js"}
    assert {r["path"] for r in t["skipped"].collect()} == {"tests/app.test.js", "src/view.tsx", "lib/user.spec.js"}
    assert {r["name"] for r in t["functions"].collect()} == {"listUsers", "createUser", "pong"}
    ends = {(r["method"], r["path"], r["handler_function_id"] is not None) for r in t["endpoints"].collect()}
    assert ends == {("GET", "/health", False), ("GET", "/api/users", True), ("POST", "/api/users", True), ("DELETE", "/api/users/:id", False), ("GET", "/v/v1/ping", True)}
    paths = {r["id"]: r["path"] for r in t["modules"].collect()}
    edges = {(paths[r["from_module_id"]], paths[r["to_module_id"]]) for r in t["import_edges"].collect()}
    assert edges == {("app.js", "routes/users.js"), ("app.js", "routes/api/index.js"), ("routes/api/index.js", "routes/api/ping.js"), ("routes/api/ping.js", "routes/users.js"), ("routes/api/ping.js", "app.js")}
    assert [(r["name"], r["dep_type"]) for r in t["external_deps"].orderBy("pos").collect()] == [("express", "runtime"), ("jest", "dev")]
    assert [(r["path"], r["config_type"]) for r in t["config_files"].collect()] == [("package.json", "build")]


def test_nest(trees):
    t = R.parse(trees.filter("repo_name = 'nst'"), "nestjs")
    assert {r["name"]: r["implements_raw"] for r in t["classes"].collect()} == {"UsersController": ["OnModuleInit"], "UsersService": [], "Deep": [], "S": []}
    assert {(r["method"], r["path"], r["unresolved_path"]) for r in t["endpoints"].collect()} == {("GET", "/users/:id", False), ("POST", "/users", False), ("UNKNOWN", "/v1/deep", False), ("PUT", "/z", True)}
    f = {r["name"]: r["is_api_handler"] for r in t["functions"].collect()}
    assert f == {"findOne": True, "create": True, "helper": False, "find": False, "any": True, "z": True, "free": False}
    paths = {r["id"]: r["path"] for r in t["modules"].collect()}
    edges = {(paths[r["from_module_id"]], paths[r["to_module_id"]]) for r in t["import_edges"].collect()}
    assert edges == {("src/users.controller.ts", "src/users.service.ts"), ("src/users.controller.ts", "src/app/deep.ts"), ("src/users.controller.ts", "src/special.ts")}


def test_lexer_odd_input():
    for text in ("", "'open", "/* open", "`a${'`'}`", "((]", "a = b / c / d; app.get('/x', y)", "import", "class", "@"):
        s = lexer.Source.of(text)
        lexer.requires(s), lexer.imports(s), lexer.functions(s), lexer.routes(s), lexer.mounts(s), lexer.classes(s)
    assert lexer.routes(lexer.Source.of("a = b / c / d; app.get('/x', y)"))[0]["path"] == "/x"


def test_urls(spark):
    rows = spark.createDataFrame([(" https://github.com/a/b.git ",), ("https://github.com/a/b/",), ("http://github.com/a/b",), ("https://example.com/a/b",), (None,)], "u string")
    assert [r[0] for r in rows.select(R.valid_url(rows["u"])).collect()] == [True, True, False, False, None]
    assert rows.select(R.url_parts(rows["u"])).first()[0].repo == "b"
