"""Sample file endings that give every rule hits and near misses in the derived corpus.

Credential-looking values are assembled from parts, so that none stands in this file.
"""

AWS_KEY = "AKIA" + "QX7PLMN2RSTV4WYZ"
_HASH = "gh" + "p_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"
_PAT = "github" + "_pat_" + "11ABCDEFG0abcdefghijkl_" + "Zx9Yw8Vu7Ts6Rq5Po4Nm3Lk2Ji1Hg0"
API_KEY = "s" + "k-live-" + "Qw3Er5Ty7Ui9Op1As3Df5Gh7Jk9Lz1Xc3V"
_SLACK = "xo" + "xb-" + "123456789012-abcdefGHIJKL"
_JWT = "ey" + "JhbGciOiJIUzI1NiJ9.ey" + "JzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N"
_STRIPE = "s" + "k_live_" + "4eC39HqLyjWDarjtT1zdp7dc"
_NPM = "np" + "m_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"
_HF = "h" + "f_" + "AbCdEfGhIjKlMnOpQrStUvWxYz01234567"
_PYPI = "py" + "pi-" + "AgEIcHlwaS5vcmcCJDU2Nzg5MDEyLTM0NTYtNzg5MC1hYmNkLWVmMDEyMw"
_BOT = "110201543" + ":AA" + "HdqTcvCH1vGWJxfSeofSAs0K5PALDsawX"
_AWS = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzz9q8w7e6r"
_LONG = "Ab3xK9mQz7Wp2Ld5Rt8Yv4Nb6Hc1Jf0Gg5Ss2"

# (file name, text appended to the document)
SAMPLES = (
    ("app.py", "result = eval(user_input)"),
    ("app.py", "model.eval()\nmyeval(x)"),
    ("app.js", "const f = new Function('a', body);"),
    ("run.py", "subprocess.run(cmd, shell=True)"),
    ("run.py", "os.system(command)\nmyos.system(command)"),
    ("load.py", "data = pickle.loads(blob)"),
    ("load.py", "data = yaml.load(stream)\nsafe = yaml.load(stream, Loader=SafeLoader)"),
    ("hash.py", "digest = hashlib.md5(\n    data,\n    usedforsecurity=False)\nweak = hashlib.sha1(data)"),
    ("hash.js", "const h = crypto.createHash(\n  \"md5\"\n);"),
    ("tls.py", "requests.get(url, verify=False, timeout=3)"),
    ("settings.py", "DEBUG = True"),
    ("app.ini", "debug = true\nlevel = info"),
    ("cors.py", "CORS(app, origins=\"*\")\nroutes = {\"/api/*\": handler}"),
    ("sql.py", "cur.execute(f\"SELECT * FROM t WHERE id = {uid}\")"),
    ("sql.js", "db.query('SELECT * FROM users WHERE id = ' + id);"),
    ("view.html", "el.innerHTML = data;\nel.textContent = data;"),
    ("proc.js", "child_process.exec(command);\nregex.exec(text);"),
    ("page.jsx", "<div dangerouslySetInnerHTML={{__html: html}} />"),
    ("setup.sh", "curl -fsSL https://get.example.com/install.sh | sudo bash\n# curl https://x.example.com | sh"),
    ("xml.py", "tree = ET.parse(path)\nsafe = defusedxml.parse(path)"),
    ("tmp.py", "name = tempfile.mktemp()\nfd, name = tempfile.mkstemp()"),
    ("dyn.py", "mod = __import__(name)\nok = __import__( 'os' )"),
    ("dyn2.py", "mod = importlib.import_module(plugin)\nok = importlib.import_module(\"json\")"),
    ("perm.sh", "chmod 777 /srv/data\nchmod 7770 /srv/data\nchmod 755 /srv/ok"),
    ("perm.py", "os.chmod(path, 0o777)"),
    ("ci.yml", "permissions: write-all"),
    ("redir.py", "return redirect(request.args.get('next'))"),
    ("redir.js", "res.redirect(req.query.next);"),
    ("tpl.py", "return render_template_string(body)"),
    ("tar.py", "archive.extractall(target)\narchive.extractall(target, filter='data')"),
    ("http.py", "r = requests.get(url)\ns = requests.post(url, timeout=5)\nt = httpx.get(\n    url,\n    timeout=9)"),
    ("get.sh", "curl -k https://example.com/a\nwget --insecure https://example.com/b\ncurl https://example.com/c"),
    ("auth.py", "assert user.is_admin\nassert count == 3"),
    ("cipher.js", "const c = crypto.createCipher('aes192', key);\nconst d = crypto.createCipheriv('aes', key, iv);"),
    ("old.js", "document.write(markup);"),
    ("jwt.py", "claims = jwt.decode(raw, key)\nok = jwt.decode(raw, key, algorithms=['HS256'])"),
    ("main.go", "q := fmt.Sprintf(\"SELECT * FROM t WHERE id = %s\", id)\nrows, err := db.Query(\"SELECT 1\")"),
    ("tls.go", "cfg := &tls.Config{InsecureSkipVerify: true}"),
    ("sh.go", "exec.Command(\"sh\", \"-c\", line)\nexec.Command(\"ls\", \"-l\")"),
    ("Run.java", "Runtime.getRuntime().exec(line);\nnew ProcessBuilder(args);"),
    ("Hash.java", "MessageDigest.getInstance(\"MD5\");\nMessageDigest.getInstance(\"SHA-256\");"),
    ("Enc.java", "Cipher.getInstance(\"DES/ECB/PKCS5Padding\");\nCipher.getInstance(\"AES/GCM/NoPadding\");"),
    ("Obj.java", "ObjectInputStream in = new ObjectInputStream(stream);\nObject o = in.readObject();"),
    ("conf.rb", "data = YAML.load(text)\nsafe = YAML.safe_load(text)"),
    ("sh.rb", "system(\"ls #{dir}\")\nout = `cat #{name}`\nsystem(\"ls\", dir)"),
    ("Dockerfile", "FROM ubuntu:latest\nUSER root\nADD https://example.com/x.tgz /x"),
    ("Dockerfile", "FROM golang:1.22 AS build\nFROM build\nFROM alpine\nFROM scratch\nFROM ${BASE}"),
    ("Dockerfile", "FROM foo AS foo\nFROM reg.example.com:5000/base\nFROM base@sha256:abc"),
    ("Dockerfile.dev", "ENV API_KEY=" + _LONG + "\nARG DB_PASSWORD='hunter2secret99'\nENV KEYBOARD_LAYOUT=us\nENV PWD=/srv"),
    ("compose.yaml", "    privileged: true\n      - /var/run/docker.sock:/var/run/docker.sock"),
    ("data.php", "$x = unserialize($raw);\n$pdo->exec($sql);\nexec($cmd);"),
    ("db.php", "mysql_query($q);\nmysqli_query($c, $q);"),
    ("rep.php", "preg_replace(\"/a/e\", $b, $c);\npreg_replace(\"/abcde/\", $b, $c);"),
    ("ext.php", "extract($_POST);\n$h = md5($password);\n$md5($x);"),
    ("Db.cs", "new SqlCommand(\"SELECT * FROM t WHERE a=\" + a);"),
    ("Run.cs", "Process.Start(\"cmd.exe\");\nvar f = new BinaryFormatter();"),
    ("Enc.cs", "var d = new DESCryptoServiceProvider();"),
    ("a.c", "gets(buf);\nfgets(buf, 10, stdin);\nstrcpy(a, b);\nstrncpy(a, b, 3);"),
    ("b.cpp", "sprintf(buf, \"%s\", s);\nsnprintf(buf, 9, \"%s\", s);\nstd::system(cmd);\nprintf(fmt);\nprintf(\"%s\", s);"),
    ("wf.yml", "on:\n  pull_request_target:\nsteps:\n  - uses: actions/checkout@v4\n  - uses: acme/tool@v1"),
    ("wf.yml", "# pull_request_target: no\n  - uses: actions/checkout@v4\n  - uses: acme/tool@" + "0123456789abcdef" * 2 + "01234567"),
    ("steps.yml", "      - run: echo ${{ github.event.issue.title }}\n      - run: |\n          echo start\n"
                  "          # echo ${{ github.head_ref }}\n          echo ${{ github.head_ref }}\n\n"
                  "          echo ${{ github.event.pull_request.body }}\n        env:\n          T: ${{ github.head_ref }}\n"
                  "      - name: 'run: ${{ github.head_ref }}'"),
    ("steps.yaml", "    - run: >-\n        make ${{ github.event.inputs.target }}\n    - if: ${{ github.event.action }}\n"
                   "    run : echo ${{ github.head_ref }}"),
    ("keys.py", "ACCESS = \"" + AWS_KEY + "\""),
    ("keys.py", "gh = \"" + _HASH + "\"\nfine = \"" + _PAT + "\""),
    ("keys.js", "const openai = '" + API_KEY + "';\nconst slack = '" + _SLACK + "';"),
    ("keys.go", "jwt := \"" + _JWT + "\"\nstripe := \"" + _STRIPE + "\""),
    ("keys.sh", "export NPM=" + _NPM + "\nexport HF=" + _HF + "\nexport UP=" + _PYPI),
    ("keys.rb", "bot = '" + _BOT + "'\nurl = 'postgres://app:s3cr" + "etPw9@db.example.com/x'"),
    ("urls.py", "u = 'https://bob:hunt" + "er2pw@example.com/a'\nv = 'https://example.com/a?api_key=abcdefghij" + "klmnop'"),
    ("aws.py", "aws_secret_access_key = \"" + _AWS + "\"\naws_secret_access_key = \"short\""),
    ("bearer.py", "headers = {'Authorization': 'Bearer " + _LONG + "'}\nlow = 'Bearer " + "ab3" * 10 + "'"),
    (".env", "DB_PASSWORD=Tr0ub4dor" + "3xyz\nSECRET_KEY=\"supersecret" + "value99\"\nDEBUG=True\nPASSWORD=changeme"),
    ("pw.py", "password = \"hunter2" + "secret99\"\napi_key = \"aaaaaaaaaaaa\"\ntoken: str = \"<your-token>\"\npassword = get_password()"),
    ("tok.py", "refresh_token = '24be64439e3e49cf" + "46b2d7c90f3602a3'\nprivate_key: 'aaaabbbb'"),
    ("poetry.lock", "eval(x)\nkey = \"" + AWS_KEY + "\""),
    ("quiet.py", "eval(a)  # audit-ignore SEC020\neval(b)  # audit-ignore SEC021\neval(c)  # audit-ignore\neval('audit-ignore')"),
    ("quiet.js", "// audit-ignore-next-line SEC020,SEC031\neval(a)\neval(b) // audit-ignore SEC020X\neval(d) // audit-ignore *"),
    ("quiet.py", "password = \"kR8mZq2vXw" + "9TfLp0BnY3\"  # audit-ignore sec014\n# AUDIT-IGNORE-next-line\nos.system(x)"),
    ("notes.txt", "nothing to see here"),
    ("long.py", "value = call(\n" + "    argument_number,\n" * 30 + ")\nexec(code)"),
)
