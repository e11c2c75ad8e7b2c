"""Questions in words against the commands that answer them: recall among the first five."""

from runlore.operators.search import search_expanded
from runlore.sources.concepts import SHIPPED, load_concepts

ASKED = [
    ("how do i undo the last commit", "git reset --soft HEAD~1"), ("restart the web service", "systemctl restart nginx"), ("which process is using the port", "lsof -i :8080"), ("show disk space", "df -h"),
    ("compress the reports folder", "tar czf reports.tgz reports"), ("extract the archive", "tar xzf backup.tgz"), ("make a copy to the server", "scp build.zip web01:/srv"), ("download the file", "wget https://h.test/a.iso"),
    ("follow the logs", "journalctl -u api -f"), ("delete old container", "docker rm -f old_api"), ("list pods", "kubectl get pods -n prod"), ("scale the deployment", "kubectl scale deploy/api --replicas=4"), ("roll back: rollback the release", "helm rollback api 3"),
    ("create a virtual environment", "python -m venv .venv"), ("install dependencies", "pip install -r requirements.txt"), ("run the test", "pytest -q tests"), ("check the certificate", "openssl x509 -in tls.crt -noout -dates"),
    ("dump the database", "pg_dump shop > shop.sql"), ("migrate the schema", "alembic upgrade head"), ("find files bigger", "find . -name '*.bin'"), ("search text in sources", "grep -rn TODO src"), ("change permissions of a script", "chmod 755 deploy.sh"),
    ("who changed this line", "git blame src/app.py"), ("switch branch", "git checkout release-2"), ("compare two files", "diff -u a.conf b.conf"), ("verify checksum", "sha256sum image.iso"), ("memory in use", "free -m"), ("cpu cores", "nproc"),
    ("ssh tunnel to the staging machine", "ssh -L 5432:db:5432 bastion"), ("generate a new key", "ssh-keygen -t ed25519"), ("schedule a job every night", "crontab -e"), ("block an address with the firewall", "ufw deny from 203.0.113.9"), ("capture packets", "tcpdump -i eth0 port 443"),
    ("convert the video", "ffmpeg -i a.mov a.mp4"), ("parse the json", "jq .items data.json"), ("kill the hung program", "pkill -f worker"), ("mount the drive", "mount /dev/sdb1 /mnt"), ("encrypt the notes", "gpg -c notes.txt"), ("sync the bucket", "aws s3 sync ./site s3://site"),
    ("trace system calls", "strace -p 4242"), ("lint the scripts", "shellcheck run.sh"), ("publish the package", "npm publish"), ("dns record of the domain", "dig h.test MX"), ("reboot the machine", "shutdown -r now"),
]
OTHERS = [
    "ls -la", "cd src", "vim app.py", "cat README.md", "echo done", "git status", "git log --oneline", "git add -A", "git push origin main", "git pull --rebase", "docker ps", "docker build -t api .", "docker logs api", "kubectl apply -f k8s", "kubectl describe node n1",
    "make all", "npm run dev", "cargo build", "go vet ./...", "psql shop", "redis-cli ping", "curl -s localhost:8080/health", "ping -c 3 h.test", "top -b -n1", "ps aux", "du -sh .", "head -n 5 a.csv", "sort -u names.txt", "terraform plan", "helm list", "screen -ls", "uname -a",
]
NOW = 1_800_000_000


def test_recall_at_five(spark):
    rows = [(i, c, NOW - 3600 * (len(ASKED) + len(OTHERS) - i), "/w") for i, c in enumerate([a for _, a in ASKED] + OTHERS)]
    h = spark.createDataFrame(rows, "seq long, command string, ts long, repo string").cache()
    concepts, stop = load_concepts()
    missed = []
    for question, answer in ASKED:
        if answer not in [r.command for r in search_expanded(h, question, concepts, stop, NOW, "/w", 5).select("command").collect()]:
            missed.append(question)
    print("recall at 5:", 1 - len(missed) / len(ASKED), missed)
    assert len(missed) <= 0.1 * len(ASKED), missed


def test_map_is_well_formed():
    assert len(SHIPPED) >= 150 and all(k == k.lower() and v and all(s.strip() for s in v) for k, v in SHIPPED.items())
