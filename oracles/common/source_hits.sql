-- uses: part_text
select project_id, n, x.f as rel, x.l as line, x.s as signal, x.t as token, x.c as confidence from (
 select project_id, n, unnest([
  {'f':'cmd/main.go','l':4,'s':'bin','t':n,'c':'high'},{'f':'cmd/main.go','l':5,'s':'bin','t':'tool'||k,'c':'high'},
  {'f':'a/run.py','l':3,'s':'bin','t':'py'||k,'c':'high'},{'f':'a/run.py','l':4,'s':'bin','t':'sys'||k,'c':'medium'},{'f':'a/run.py','l':6,'s':'host','t':'api.svc'||k||'.io','c':'medium'},
  {'f':'web/x.ts','l':3,'s':'bin','t':'js'||k,'c':'high'},{'f':'web/x.ts','l':4,'s':'host','t':'api.svc'||k||'.io','c':'medium'},
  {'f':'s.sh','l':3,'s':'bin','t':'sh'||k,'c':'medium'},{'f':'s.sh','l':3,'s':'bin','t':'other'||k,'c':'medium'},{'f':'s.sh','l':6,'s':'runner','t':'tool-'||k,'c':'medium'},
  {'f':'s.sh','l':7,'s':'bin','t':'curl','c':'medium'},{'f':'s.sh','l':7,'s':'host','t':'dl.svc'||k||'.io','c':'medium'},
  {'f':'Dockerfile','l':2,'s':'image','t':'img'||k,'c':'high'},{'f':'Dockerfile','l':1,'s':'image','t':'--platform=x','c':'high'},{'f':'Dockerfile','l':3,'s':'bin','t':'apt'||k,'c':'medium'},{'f':'Dockerfile','l':4,'s':'bin','t':'ent'||k,'c':'high'},
  {'f':'.github/workflows/ci.yml','l':6,'s':'bin','t':'ci'||k,'c':'medium'},{'f':'.github/workflows/ci.yml','l':1,'s':'bin','t':'two'||k,'c':'medium'},
  {'f':'.env.example','l':2,'s':'env','t':'KEY_'||k,'c':'high'}]) as x from part_text)
