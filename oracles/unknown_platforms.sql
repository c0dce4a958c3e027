-- uses: page_platform
select project_id, 'E-CORPUS-004' as code, 'host' as signal, host as token, 'no terms on record for service ''' || host || ''' at pages/' || page_id || ':1' as message from page_platform where platform is null
