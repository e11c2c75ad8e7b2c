"""Concept maps: what words of a question are called in a shell."""

from __future__ import annotations

import json
import logging
from pathlib import Path

#: What people call things, and what shells call them: one idea a line. A tilde stands for a blank, where a word must
#: end or begin. A deployment layers its own JSON file over it.
_MAP = """
access log = access.log, access_log
account = useradd, adduser, passwd~, gcloud auth, aws sts
add = git add, npm install, pip install, cargo add, useradd
address = ip addr, ifconfig, hostname -I, nslookup, dig~
alias = alias~, unalias
amend = git commit --amend, rebase -i
archive = tar~, zip~, gzip
audio = ffmpeg, sox~, afplay
authenticate = login, gh auth, aws sso, gcloud auth, kinit
autostart = systemctl enable, crontab, launchctl
background = tmux, nohup, screen
backup = rsync, pg_dump, mysqldump, tar~, restic, borg
balance = haproxy, nginx, ipvsadm
bandwidth = iftop, nethogs, iperf
base64 = base64, openssl enc
battery = upower, acpi, pmset
benchmark = hyperfine, ab~, wrk~, time~
big files = du~, ncdu, find . -size
binary = xxd, hexdump, objdump, strings~
block = iptables, ufw deny, nft~
boot = systemctl, grub, dmesg, journalctl -b
branch = git branch, git checkout, git switch
browse = less~, more~, ranger, xdg-open
bucket = aws s3, gsutil, mc ls
build = make, cargo build, go build, docker build, npm run build
bundle = webpack, vite build, npm run build, esbuild
cache = redis-cli, npm cache, pip cache, ccache
calendar = cal~, date~
cancel = git rebase --abort, git merge --abort, kill~, scancel
certificate = openssl, certbot
change directory = cd~, pushd
changes = git diff, git status, git show
checksum = sha256sum, md5sum
cherry pick = git cherry-pick
clean = make clean, git clean, docker system prune, docker image prune, cargo clean, rm -rf
clone = git clone, gh repo clone
cloud = aws~, gcloud, az~, terraform
cluster = kubectl, helm
coverage = pytest --cov, go test -cover, nyc, tarpaulin
column = cut -, awk~
command history = history, fc~
commit = git commit
compare = diff
compile = gcc, g++, make, cargo build, go build, tsc, javac
compress = gzip, tar~, zip~, zstd, xz~
config = git config, kubectl config, sysctl
connect = ssh~, psql, mysql
container = docker, podman, kubectl exec
convert = ffmpeg, convert~, pandoc, iconv
copy = cp~, scp~, rsync
core = gdb~, lldb, coredumpctl
count = wc~, uniq -c
cpu = top, htop, mpstat, nproc, lscpu
create directory = mkdir
cron = crontab, systemctl list-timers
csv = csvcut, awk -F, duckdb, sqlite3
database = psql, mysql, pg_dump, redis-cli, alembic
debug = gdb~, lldb, pdb, strace, --inspect, dlv~
decode = base64 -d, jq~, openssl
decrypt = gpg -d, gpg --decrypt, openssl enc -d, age -d, sops
delete = rm~, git branch -d, kubectl delete, docker rm, drop
dependencies = npm ci, npm install, pip install, go mod
deploy = helm upgrade, kubectl rollout, terraform apply, rsync
device = lsblk, lsusb, lspci, fdisk
directory size = du~, ncdu
disk space = df~, du~
dns = dig~, nslookup, host~, resolvectl
docs = man~, mkdocs, sphinx-build, --help
domain = dig~, whois, nslookup
download = curl -o, wget
dump = pg_dump, mysqldump
duplicate = fdupes, uniq -d, sort -u
edit = vim~, nano~, sed -i, crontab -e
email = mail~, sendmail, mutt
encoding = iconv, file -i, chardet
encrypt = gpg, openssl enc, age~, sops
end of file = tail~
environment = env~, printenv, export~, direnv, .env
errors = journalctl -p err, grep -i error, dmesg, stderr
events = kubectl get events, journalctl, watch~
execute = docker exec, kubectl exec, bash~, chmod +x
expose = kubectl expose, ngrok, port-forward, docker run -p
extract = tar x, tar -x, unzip, gunzip, 7z x
failed jobs = systemctl --failed, kubectl get pods, git bisect
fetch = curl~, git fetch, wget, http~
file type = file~, mimetype
find files = find~, fd~, locate, git ls-files
firewall = ufw, iptables, firewall-cmd, nft~
fix = fmt, lint
flash = dd~, esptool, fastboot
follow = tail -f, tail -F, logs -f, journalctl -f
forget host = ssh-keygen -R
format code = black~, prettier, gofmt, cargo fmt, ruff format, clang-format
forward = port-forward, ssh -L, socat
free memory = free~, vmstat, sync
function = aws lambda, gcloud functions, declare -f
graph = dot~, gnuplot, git log --graph
group = usermod, groupadd, chgrp
hash = sha256sum, md5sum, git rev-parse, shasum
headers = curl -I, curl -i, http --headers
health = curl~, kubectl get, systemctl status, docker ps
heap = jmap, heapdump, pprof
history of file = git log --follow, git blame, git log -p
hook = pre-commit, git config core.hookspath, husky
image = docker build, docker pull, docker images, convert~
import = \\copy, mysqlimport, mongoimport, pg_restore, psql -f
index = create index, reindex, updatedb
infrastructure = terraform
inspect = docker inspect, kubectl describe, jq~
install = apt install, apt-get install, brew install, pip install, npm install, cargo install, dnf install
ip address = ip addr, ifconfig, curl ifconfig.me
job = jobs, kubectl get jobs, crontab, squeue
json = jq~, python -m json.tool, fx~
kernel = uname, dmesg, modprobe, sysctl
key = ssh-keygen, gpg --gen-key, ssh-add, openssl genrsa
kill = kill~, pkill
latency = ping~, mtr~, traceroute
launch = docker run, npm start, systemctl start, open~
lines = wc -l, sed -n, head~, tail~
link = ln -s, readlink
lint = eslint, ruff, flake8, golangci-lint, clippy, shellcheck
listening = lsof -i, ss -l, netstat
load = uptime, top, w~
load test = wrk~, ab~, k6~, locust
lock = flock, terraform force-unlock, poetry lock
login = ssh~, docker login, gh auth login, aws sso login
logs = journalctl, tail~, docker logs, kubectl logs
memory = free~, vmstat, htop, ps aux --sort=-%mem
merge = git merge, git rebase, git pull
metrics = prometheus, curl localhost:9090, kubectl top
migrate = alembic, migrate
mirror = rsync, wget -m, git clone --mirror
monitor = watch~, htop, top, kubectl top
mount = mount~, sshfs, lsblk
move = mv~, git mv
network = nc~, dig~, curl, ping
new files = git status, find . -newer, git ls-files --others
notebook = jupyter
open files = lsof, fuser
outdated = npm outdated, pip list --outdated, brew outdated, apt list --upgradable
owner = chown, stat~, git blame
package = npm~, npm pack, dpkg, rpm~, brew, apt, cargo publish
packets = tcpdump, tshark, ngrep
parallel = xargs -P, parallel, make -j
password = passwd, htpasswd, pass~
patch = git apply, git format-patch, patch~
path = which~, pwd, realpath, echo $PATH
permissions = chmod, chown
pods = kubectl get pods, kubectl describe pod
pool = pgbouncer, zpool, ceph osd
port = port-forward, nc~, lsof
preview = npm run preview, mkdocs serve, head~
process = ps~, top
profile = perf~, py-spy, pprof, cprofile
proxy = http_proxy, nginx, socat, ssh -D
publish = npm publish, cargo publish, twine upload, docker push
pull request = gh pr, git push -u
push = git push, docker push
query = psql -c, mysql -e, sqlite3, duckdb, bq query
queue = rabbitmqctl, kafka-console, redis-cli llen, celery
rate = pv~, iperf, vnstat
rebuild = make clean, docker build --no-cache, docker compose up --build
reboot = reboot, shutdown -r
recent = history, git log, ls -lt
recover = git reflog, fsck, testdisk, pg_restore
release = gh release, git tag, npm version, helm upgrade
remote = git remote, ssh~
remove = rm~, git rm, apt remove, docker rm, docker rmi, pip uninstall
rename = mv~, git mv, git branch -m, rename~
repair = fsck, git fsck, btrfs check, xfs_repair
replace = sed -i, sed s, perl -pi, sd~
request = curl, http~, grpcurl
reset = git reset, tput reset, redis-cli flushall
resize = convert -resize, lvextend, resize2fs, kubectl scale
restart = systemctl restart, rollout restart
restore = pg_restore, git restore, git checkout --, restic restore
resume = fg~, wget -c, tmux attach, curl -C
review = gh pr, git diff, git log
rollback = rollout undo, helm rollback, alembic downgrade, git revert
route = ip route, traceroute, netstat -r
rows = psql -c, wc -l, select count
run tests = pytest, npm test, cargo test, go test, make test
sample = shuf, head~, jq .[0]
scale = kubectl scale, docker compose up --scale, autoscale
scan = nmap, trivy, clamscan, nikto
schedule = crontab, at~, systemctl list-timers
schema = pg_dump -s, \\d~, alembic, describe
screen = tmux, screen~, scrot
search text = grep, rg~
secret = kubectl get secret, vault, sops, pass~
serve = python -m http.server, npm run dev, nginx, flask run, uvicorn
service = systemctl, kubectl get svc, docker compose
session = tmux, screen -r, who~
sign = gpg --sign, git commit -S, codesign, cosign
size = du~, ls -lh, wc -c
snapshot = zfs snapshot, aws ec2 create-snapshot, lvcreate -s, etcdctl snapshot
sort = sort~
split = split~, csplit
stage = git add
start = systemctl start, docker start, npm start, docker compose up
stash = git stash
stats = pg_stat, docker stats, iostat, vmstat
status = git status, systemctl status, kubectl get, docker ps
stop = systemctl stop, docker stop, kill~, docker compose down
submodule = git submodule
subnet = ipcalc, ip route
swap = swapon, swapoff, free~
sync = rsync, aws s3 sync, git pull, rclone
system info = uname, hostnamectl, lscpu, neofetch
tables = \\dt, show tables, .tables
tag = git tag, docker tag
template = helm template, envsubst, cookiecutter
terminal = tmux, tput, stty
test = pytest, cargo test, go test, make test
threads = ps -T, jstack, top -H
time = date~, timedatectl, time~
trace = strace, traceroute, bpftrace
traffic = tcpdump, iftop, nethogs
transfer = scp~, rsync, sftp
translate = tr~, iconv
trust = update-ca-certificates, ssh-copy-id, gpg --import
tunnel = ssh -L, ssh -R, ssh -D, ngrok, cloudflared
type check = mypy, tsc, pyright
undo = git reset, git revert, git stash
uninstall = apt remove, pip uninstall, brew uninstall, npm uninstall
update = apt update, apt upgrade, brew upgrade, npm update, git pull
upload = aws s3 cp, scp~
uptime = uptime, systemctl status
url = curl~, wget, open http
users = who~, getent passwd, useradd, last~
vacuum = vacuum, vacuumdb
validate = kubectl apply --dry-run, terraform validate, xmllint, yamllint
version = --version, node -v, git describe, git tag
video = ffmpeg, yt-dlp
virtual environment = venv, virtualenv, conda, poetry shell
volume = docker volume, lvs~, kubectl get pvc
vulnerabilities = npm audit, trivy, pip-audit, cargo audit
wait = sleep~, wait~, kubectl wait
watch = watch~, tail -f, entr~
webserver = nginx, apachectl, python -m http.server
who changed = git blame, git log -p, last~
wifi = nmcli, iwconfig, iw~
workspace = terraform workspace, npm -w, cargo -p
yaml = yq~, yamllint
zombie = ps aux, kill -9
back = rollback, rollout undo, git revert, cd -
calls = strace, ltrace, perf trace
deployment = kubectl, helm
drive = mount~, lsblk, df~, fdisk
generate = ssh-keygen, openssl gen, uuidgen, npm init
list = ls~, kubectl get, docker ps, git branch
new = mkdir, touch~, git init, ssh-keygen
parse = jq~, awk~, yq~
program = pkill, ps~, which~
run = pytest, npm start, docker run, bash~, make~
system = strace, uname, systemctl, top
tests = pytest, cargo test, go test, make test, npm test
"""
SHIPPED: dict[str, list[str]] = {
    name.strip(): [w.strip().replace("~", " ").replace("\\\\", "\\") for w in called.split(",")] for name, _, called in (line.partition("=") for line in _MAP.strip().splitlines())
}
STOPWORDS = frozenset(
    """a about again all am an and any are as at be been but by can could did do does everything for from get got had has have how i if in into is it its just last let made make many me much my need of off on or our out over
    please should show so some than that the their them then there these they thing things this those to too up us use used using want was way we were what when where which who why will with would yesterday you your command""".split()
)


def load_concepts(path: str | None = None) -> tuple[dict[str, list[str]], set[str]]:
    """The shipped map with the user's file layered over it: concepts replace, stopwords add.

    A file that is missing or broken leaves the shipped map as it is, with a warning for the latter.
    """
    concepts, stop = dict(SHIPPED), set(STOPWORDS)
    if path and Path(path).exists():
        try:
            raw = json.loads(Path(path).read_text(encoding="utf-8"))
            own = {k.lower(): [s for s in v if isinstance(s, str)] for k, v in raw.items() if isinstance(v, list) and not k.startswith("_")}
            stop |= {w for w in raw.get("_stopwords", []) if isinstance(w, str)}
            concepts |= own
        except (OSError, ValueError, AttributeError) as e:
            logging.getLogger(__name__).warning("concept map %s is not usable: %s", path, e)
    return concepts, stop
