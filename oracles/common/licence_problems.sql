-- uses: licence_entries
select licence_id as subject, unnest([
  case when trim(spdx_id) = '' then 'no identifier' end, case when family = 'weird' then 'unknown family' end, case when permissiveness not between 1 and 5 then 'permissiveness' end,
  case when confidence = 'MAYBE' then 'confidence' end, case when not (url and case when excerpt then excerpt_kind = 1 else excerpt_kind = 0 end) then 'citation' end,
  case when not verified then 'last verified' end, case when corrected and not (evidence and raised) then 'correction' end,
  case when spdx_id = 'Apache 2.0' then 'alias as identifier' end]) as problem from licence_entries
